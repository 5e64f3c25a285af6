"""The training-data operators against plain versions, and their edge cases."""

import collections
import hashlib
import html
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import chat, fertility, golay, jpeg, langid, mainhtml, mixing, packing, quality, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to house tree water light people work".split(), "fr": "le la les des maison arbre eau lumière gens travail".split(), "de": "der die das und haus baum wasser licht leute arbeit".split()}


def docs_of(spark, *texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(rng, lang="en", n=60):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def mixed_docs(spark):
    """Three languages, with null, empty, wordless, long and repeated texts, and a column named like a result."""
    rng = random.Random(1)
    rows = [(i, prose(rng, k), k, f"s{i % 4}", 1) for i in range(60) for k in [("en", "fr", "de")[i % 3]]]
    rows += [(100, None, "en", None, None), (101, "", None, "s0", 0), (102, "  \n\t 12 !?", "en", "s0", 3), (103, prose(rng, "en", 30_000), "en", "s0", 1), (0, rows[0][1], "en", "s0", 1), (None, prose(rng), "en", "s1", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("mine")).withColumn("kept", F.lit(1))


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- 1 quality


def test_quality_learns(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng) if i % 2 else " ".join("WIN!!" for _ in range(40)), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got) and len(got) == 300


def test_quality_edges(spark, mixed_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(mixed_docs, quality.train(mixed_docs, none)).collect()
    assert len(got) == mixed_docs.count() and {r.score for r in got} == {0.5}
    assert quality.score(empty(spark), quality.train(empty(spark), none)).count() == 0


def plain_words(part):
    """Rows of one part, a word at a time."""
    out, seen = [], []
    for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\x20\x09-\x0D0-9A-Za-z\x80-\U0010ffff]+", part):
        low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in w)
        up = sum(c.isascii() and c.isupper() or "À" <= c <= "Þ" and c != "×" for c in w)
        down = sum(c.isascii() and c.islower() or "à" <= c <= "ÿ" and c != "÷" for c in w)
        if low in seen[-6:]:
            out.append(quality.AGAIN)
        if up:
            out.append(quality.CAPITALS if up > 1 and not down else quality.CAPITAL)
        seen.append(low)
        out.append(low)
    return out


def test_quality_words_vectors_and_pooling_equal_a_loop(spark, monkeypatch):
    texts = ["The cat, the CAT!!", "", "é 12 É", "ÀB Ñandú straße ÷×", "win win WIN win", "x\x0by\tz\n"] + [prose(random.Random(k), "fr", 40).title() for k in range(6)]
    for step in (1_000_000, 25):
        monkeypatch.setattr(quality, "STEP", step)
        parts = [[p.decode() for p in quality.parts_of(t.encode())] for t in texts]
        assert ["".join(p) for p in parts] == texts
        number, plain = {}, [[plain_words(p) for p in ps] for ps in parts]
        for text, ps, words in zip(texts, parts, plain):
            rows, per = quality.tokens([p.encode() for p in ps])
            flat = [w for p in words for w in p]
            assert per.tolist() == list(map(len, words))
            for w, r in zip(flat, rows.tolist()):
                assert r == w if isinstance(w, int) else number.setdefault(w, r) == r
        places, signs = quality.index_vectors()
        own = np.zeros((quality.ROWS, quality.DIMENSIONS))
        for row in range(quality.ROWS):
            own[row, places[row]] = signs[row]
        sums = np.zeros_like(own)
        coded = [[[w if isinstance(w, int) else number[w] for w in p] for p in ps] for ps in plain]
        for ps in coded:
            for p in ps:
                for i in range(len(p)):
                    for j in range(max(0, i - 2), min(len(p), i + 3)):
                        sums[p[i]] += own[p[j]] * (i != j)
        want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) + own
        if step == 1_000_000:  # the tasks have the module's own step
            assert np.allclose(quality.word_vectors(docs_of(spark, *texts, None)), want, atol=1e-6)
        means = [np.mean([want[w] for p in ps for w in p], axis=0) if any(ps) else np.zeros(quality.DIMENSIONS) for ps in coded]
        assert np.allclose(quality.pooled(texts, want.astype(np.float32)), means, atol=1e-5)


def test_quality_query_learns_from_no_held_out_label(spark, small, tmp_path):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    for name, df in (("documents", docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")})), ("labels", labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    first, second = (quality.op1_quality(spark, d).toPandas().sort_values("doc_id").reset_index(drop=True) for d in (small, str(tmp_path)))
    assert first.equals(second) and len(first) == docs.count()
    assert (first.predicted == (first.score >= 0.5)).all() and first.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(first.doc_id, first.held_out))


# ---------------------------------------------------------------- 2 language


def test_language(spark, mixed_docs):
    model = langid.train(langid.training_rows(mixed_docs))
    got = langid.identify(mixed_docs, model).join(mixed_docs.select("doc_id", "lang"), "doc_id").where("doc_id < 60").collect()
    assert all(r.lang_pred == r.lang and r.score > 0.9 for r in got)
    und = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(mixed_docs, model).where("doc_id between 100 and 102").collect()}
    assert und == {100: ("und", 0.0), 101: ("und", 0.0), 102: ("und", 0.0)}
    assert model.predict("A.")[0] in model.languages
    both = model.proportions(prose(random.Random(3), "en", 300) + " " + prose(random.Random(4), "de", 300))
    assert set(both) == {"en", "de"} and 0.3 < both["en"] < 0.7
    kept = langid.keep_identified(mixed_docs, model)
    assert kept.columns == mixed_docs.columns and kept.count() == mixed_docs.count() - 3


def test_language_without_training(spark):
    assert langid.train(langid.training_rows(empty(spark))).predict("any text") == ("und", 0.0)


# ---------------------------------------------------------------- 3 mixing


def plain_edf(counts):
    total, given, out = sum(counts), [0] * len(counts), []
    for t in range(total):
        ready = [(-(-(g + 1) * total // c), i) for i, (g, c) in enumerate(zip(given, counts)) if g < c and g * total // c <= t]
        i = min(ready)[1]
        given[i] += 1
        out.append(i)
    return out


def test_frame_schedule_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(k, [rng.randint(0, 12) for _ in range(rng.randint(1, 6))]) for k in range(40)]
    rows = [(k, c if sum(c) else [1]) for k, c in rows]
    df = spark.createDataFrame(rows, "k int, counts array<long>").withColumn("length", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c))
    for r in df.select("counts", mixing.earliest_deadline_first().alias("o")).collect():
        assert r.o == plain_edf(r.counts)
        for i, c in enumerate(r.counts):
            run = np.cumsum(np.array(r.o) == i) - np.arange(1, len(r.o) + 1) * c / len(r.o)
            assert np.abs(run).max() < 1


def test_mixing(spark):
    rows = [(i, "t", "en", "a" if i < 700 else "bcd"[i % 3] if i % 50 else None, 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("mine"))
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.15), ("c", 0.05)], "source string, weight double")
    got = mixing.schedule(docs, weights, frame=20, block_docs=4).toPandas()
    assert sorted(got.doc_id) == list(range(1500))
    blocks = got.groupby(["source", "block"], dropna=False).agg(slot=("slot", "first"), r=("release", "first"), d=("due", "first"), same=("slot", "nunique")).reset_index()
    assert (blocks.same == 1).all() and sorted(blocks.slot) == list(range(len(blocks)))
    assert ((blocks.r <= blocks.slot) & (blocks.slot < blocks.d)).all()
    out = mixing.mixed(docs, weights, frame=20, block_docs=4)
    assert out.columns == docs.columns and out.count() == 1500
    order = dict(zip(got.doc_id, zip(got.slot, got.in_block)))
    seen = [order[r.doc_id] for r in out.collect()]
    assert seen == sorted(seen)
    assert mixing.schedule(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def asked(blocks, weights, slots):
    """Blocks of each source after so many slots, if all go on by their weights until they run out."""
    done, at = [0.0] * len(blocks), 0.0
    while at < slots - 1e-9:
        on = [i for i, b in enumerate(blocks) if done[i] < b - 1e-9]
        rate = sum(weights[i] for i in on)
        step = min([slots - at] + [(blocks[i] - done[i]) * rate / weights[i] for i in on])
        for i in on:
            done[i] += step * weights[i] / rate
        at += step
    return done


@pytest.mark.parametrize("blocks, weights", [([2700, 300], [0.9, 0.1]), ([700] + [70] * 19, None), ([900] + [1] * 120, [0.9] + [0.1 / 120] * 120), ([50, 400, 300], [0.6, 0.3, 0.1])])
def test_schedule_keeps_to_target_weights(spark, blocks, weights):
    names = [f"s{i:03}" for i in range(len(blocks))]
    docs = spark.createDataFrame([(k, "t", "en", names[k_], 1) for k, k_ in enumerate(i for i, b in enumerate(blocks) for _ in range(b))], DOCS)
    given = weights and spark.createDataFrame(list(zip(names, weights)), "source string, weight double")
    weights = weights or [b**mixing.TEMPER for b in blocks]
    got = mixing.schedule(docs, given, block_docs=1).toPandas().sort_values("slot")
    assert list(got.slot) == list(range(sum(blocks)))
    run = np.cumsum(got.source.to_numpy()[:, None] == np.array(names)[None, :], axis=0)
    for n in (*range(1, len(run), 7), len(run)):
        assert np.abs(run[n - 1] - asked(blocks, weights, n)).max() < 1 + 1e-6


# ---------------------------------------------------------------- 4 rules


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, marked = len(words), set()
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    for i in range(n - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            marked.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked), n < 20 or 100 * len(marked) > 30 * n


def test_rules_equal_the_plain_version(spark, mixed_docs):
    rng = random.Random(6)
    odd = ["a\x0bb\x0cc d e", "x\r\ny\r\nx\r\n", "#*$%&|<>", "\U0001f600 é " * 40, "\x01 " * 30, " ".join(rng.choice("ab") for _ in range(200)), "one two three four five six seven eight " * 5, "\n \n \n" * 4]
    docs = docs_of(spark, *odd).unionByName(mixed_docs.select(*docs_of(spark, "x").columns))
    got = fertility.measure(docs).join(docs.select("doc_id", "text"), "doc_id")
    for r in fertility.measure(docs_of(spark, *odd)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(odd[r.doc_id]), odd[r.doc_id]
    assert got.count() > 0 and fertility.measure(empty(spark)).count() == 0
    kept = fertility.keep_good(mixed_docs)
    assert kept.columns == mixed_docs.columns and {r.doc_id for r in kept.collect()} >= set(range(60))


def plain_tokens(text):
    """Measures of both vocabularies, from the whole text, a token at a time."""
    meter, out = fertility.Meter(), {}
    for v, ids in (("piece", meter.piece.encode(text)), ("byte", meter.byte.encode_ordinary(text))):
        odd = [meter.piece.is_byte(i) or meter.piece.is_unknown(i) for i in ids] if v == "piece" else [not fertility._is_text(meter.byte.decode_single_token_bytes(i)) for i in ids]
        shares, weights = [], []
        for k in range(0, len(ids), 256):
            run = ids[k : k + 256]
            if len(run) > 1:
                p = [n / len(run) for n in collections.Counter(run).values()]
                shares.append(-sum(x * np.log2(x) for x in p) / np.log2(len(run)))
                weights.append(len(run))
        out[v] = (len(ids), len(text) / len(ids) if ids else 0, sum(odd) / len(ids) if ids else 0, np.average(shares, weights=weights) if shares else 0)
    return out


def test_fertility_equals_the_plain_version(monkeypatch):
    rng = random.Random(21)
    bits = ["a", "Word", "ing", " ", "  ", "   ", "\n", "\n\n", "\t", "é", "文字", "\u3000", "\u00a0", "\r\n", "…", "x.", " 12", "'s", "😀", "\x0b", "\x00", "\u2581", "ﬁ"]
    texts = ["a b\nc d\n\ne", "Die Häuser, naïve 文字 “quotes” word.word x", "", " ", "word", " word", prose(rng, "de", 2000)]
    texts += ["".join(rng.choice(bits[: 8 if k % 2 else len(bits)]) for _ in range(rng.randint(0, 30))) for k in range(400)]
    for long in (fertility.PIECE_BYTES, 8):  # in parts of one cell too
        monkeypatch.setattr(fertility, "PIECE_BYTES", long)
        got = fertility.Meter()(texts)
        for i, text in enumerate(texts):
            for v, want in plain_tokens(text).items():
                have = [got[f"{m}_{v}"][i] for m in ("n_tokens", "chars_per_token", "byte_share", "entropy_share")]
                assert np.allclose(have, want), (text, v)
            assert plain_base(text) == tuple(got[c][i] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_bands_reject_what_lies_far_outside(spark):
    rng = random.Random(22)
    texts = [prose(rng, "en", 40) for _ in range(200)] + [" ".join("".join(rng.choice("qxzjkvw") for _ in range(9)) for _ in range(40)), " ".join(prose(rng, "en", 40) + " 𓀀" * 60 for _ in range(1))]
    texts += ["строка " + " ".join(rng.choice(["вода", "дом", "свет", "люди"]) for _ in range(30))]
    got = {r.doc_id: r.kept for r in fertility.with_verdicts(docs_of(spark, *texts)).collect()}
    assert all(got[i] for i in range(200)) and not got[200] and not got[201] and got[202]  # a script of one document has no bands
    docs = docs_of(spark, *texts).withColumn("__rule_kept", F.lit(1)).withColumn("__rule_script", F.lit("mine")).withColumn("least_byte_share_byte", F.lit(2.0)).withColumn("band_script", F.lit("LATIN"))
    kept = fertility.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


# ---------------------------------------------------------------- 5 html


CHROME = '<body><div id="header"><ul class="menu"><li><a href="/">Home</a></li></ul></div><div class="cookie-notice">We use cookies</div>{}<div class="comments"><p>' + "nice post " * 40 + "</p></div><footer>&copy; me</footer></body>"


def test_main_text(spark):
    body = "<h1>Title &amp; more</h1><p>Caf&eacute;  <b>bo</b>ld\n text.<p>Second<aside>ad words</aside></p><form><button>Send</button></form><p>Last.</p>"
    article = f"<html><head><title>no</title><script>var a='<p>no</p>'</script></head><body><nav><a>x</a></nav><article>{body}</article><footer>f</footer></body></html>"
    rows = [(1, "u", article), (2, "u", CHROME.format(f'<div class="post-content">{body}</div>')), (3, None, None), (4, "u", ""), (5, "u", "<p>open <b>tag"), (6, "u", "<nav>only</nav>"), (7, "u", "plain"), (8, "u", "<p>x</p><!-- never closed"), (1, "u", article)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = mainhtml.extract(pages, mainhtml.learn_weights(pages)).collect()
    want = "Title & more Café bold text. Second Last."
    assert [r.text for r in got] == [want, want, "", "", "open tag", "", "plain", "x", want]
    none = pages.limit(0)
    assert mainhtml.extract(none, mainhtml.learn_weights(none)).count() == 0


@pytest.fixture(scope="module")
def learnt(spark, small):
    return mainhtml.learn_weights(spark.read.parquet(f"{small}/pages.parquet"))


def test_names_that_are_no_furniture_keep_their_paragraph(learnt):
    paras = ["First paragraph of the law article with several words.", "Second paragraph speaks about something else.", "Third and last paragraph ends the whole article."]
    odd = ['title="the hidden valley"', 'data-hidden="false"', 'data-state="hidden"', 'data-id="footer"', 'data-role="banner"', 'class="ad-hoc"', 'class="share-price"', 'class="reply"', 'id="comment-on-law"']
    for attr in odd:
        for at in range(3):
            body = "".join(f"<p {attr if i == at else ''}>{p}</p>" for i, p in enumerate(paras))
            page = f'<body><nav>menu</nav><div class="ad">Buy</div><article><h1>Title</h1>{body}</article><footer>f</footer></body>'
            assert mainhtml.main_text(page, learnt) == " ".join(["Title", *paras]), attr
    for attr in ("hidden", 'aria-hidden="true"', 'role="navigation"', 'style="display: none"', 'class="ad"'):
        page = f"<body><article><p>{paras[0]}</p><div {attr}>gone gone</div><p>{paras[1]}</p></article></body>"
        assert mainhtml.main_text(page, learnt) == " ".join(paras[:2]), attr


def test_pages_without_marks(spark, small, learnt):
    for p in spark.read.parquet(f"{small}/pages.parquet").collect():
        bare = p.html.replace("<article>", '<div id="x1">').replace("</article>", "</div>")
        assert mainhtml.main_text(bare, learnt) == mainhtml.main_text(p.html, learnt)


def test_best_region_equals_all_pairs():
    rng = random.Random(7)
    for _ in range(200):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        best = max([sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)], default=0)
        i, j = mainhtml.best_region(s)
        assert sum(s[i:j]) == max(best, 0)


def test_tables_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in mainhtml.extract(pages, mainhtml.learn_weights(pages)).collect()}
    for p in pages.collect():
        inner = re.search("<article>(.*)</article>", p.html, re.S)[1]
        parts = [html.unescape(re.sub("</?b>", "", x)) for x in re.split("</?(?:p|h1|br)>", inner)]
        assert got[p.page_id] == " ".join(y for x in parts if (y := " ".join(x.split())))


# ---------------------------------------------------------------- 6 chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\<\\/s>", "<|turn|>user<|text|>x<|end|>", "<|", "a\nb\r", "", "<<SYS>>\\[INST]", "\U0001f600<s>", "$1 \\1"]
    rows = [(k, t, ("user", "assistant", "system")[t % 3], nasty[(k + t) % len(nasty)]) for k in range(12) for t in range(k % 7 + 1)]
    rows += [(50, 0, None, None), (50, 1, "assistant", None), (51, 1, "user", "same"), (51, 1, "user", "same"), (None, 0, "user", "x"), (60, None, "user", "null turn"), (60, 0, "assistant", "then")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("mine")).withColumn("score", F.lit(9))
    done = chat.format_trees(chat.reply_chain(turns))
    read = done.select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[c].append((role or "", text or ""))
    assert {r.tree: [tuple(x) for x in r.t] for r in read} == dict(want)
    for r in read:
        assert r.loss == "".join(t for role, t in want[r.tree] if role == "assistant")
        plain = r.formatted.replace(chat.TURN, "").replace(chat.TEXT, "").replace(chat.END, "")
        assert not any(c in plain for c in ("</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>"))
    assert chat.format_trees(chat.reply_chain(turns.limit(0))).count() == 0


def test_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 4, "assistant", "end", 0.5), (2, 9, 77, "user", "orphan", 0.0)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.branch): [x.text for x in r.t] for r in chat.format_trees(nodes, branches=2).select("tree", "branch", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {(1, 1): ["q", "good", "more", "end"], (1, 2): ["q", "bad"], (2, 1): ["orphan"]}
    chain = spark.range(100).select(F.lit(3).cast("long").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    steps = chat.paths(chain).collect()
    assert sorted((r.up, r.node) for r in steps) == [(k, 99 - k) for k in range(100)]


# ---------------------------------------------------------------- 7 warc


def test_audit_equals_direct_comparison(spark):
    rng = random.Random(8)
    rows = [(i, f"u{i}", "x" * rng.randint(0, 50)) for i in range(2500)] + [(None, None, None), (7, "u7b", "again"), (7, "u7b", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("status", F.lit("mine"))
    bad, lost = {13, 700, 2049}, {5, 1024}
    copy = spark.createDataFrame([(i, u, "BROKEN" if i in bad else h) for i, u, h in rows if i not in lost] + [(9000, "new", "extra")], "page_id long, url string, html string")
    got = warc.audit(warc.records(pages), warc.records(copy)).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.status].add(r.page_id)
    assert by["differs"] == bad and by["missing"] == lost and by["extra"] == {9000} and len(got) == len(rows) + 1
    none = warc.records(pages.limit(0))
    assert warc.audit(none, none).count() == 0


def test_read_warc(spark, tmp_path):
    import gzip

    recs = [bytes(r.record) for r in warc.records(spark.createDataFrame([(1, "http://a", "<p>é</p>"), (2, "http://b", "")], "page_id long, url string, html string")).orderBy("page_id").collect()]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes(b"".join(recs))
    (tmp_path / "w/b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs))
    got = warc.read_warc(spark, str(tmp_path / "w")).orderBy("path", "offset").collect()
    assert [(r.url, bytes(r.body).decode()) for r in got] == [("http://a", "<p>é</p>"), ("http://b", "")] * 2
    assert got[1].offset == len(recs[0]) and all(r.error is None for r in got)


def test_warc_reading_goes_on_behind_broken_stretches():
    import gzip

    rec = lambda body: f"WARC/1.1\r\nWARC-Target-URI: u\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    plain = rec(b"one") + b"rubbish between" + rec(b"two") + rec(b"three")[:-10]
    got = list(warc.parse_warc(plain))
    assert [(r[3], r[4] is None) for r in got] == [(b"one", True), (None, False), (b"two", True), (None, False)]
    assert [r[0] for r in got] == list(np.cumsum([0, *[r[1] for r in got[:-1]]]))
    members = [gzip.compress(rec(x)) for x in (b"a" * 100_000, b"b", b"c")]
    packed = members[0] + members[1][:20] + members[2]
    assert [r[3] for r in warc.parse_warc(packed) if r[3]] == [b"a" * 100_000, b"c"]


def test_trees_open_only_what_differs(spark):
    rows = [(i, f"u{i}", f"x{i}") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    copy = pages.where("page_id <> 2000").withColumn("html", F.when(F.col("page_id") == 5, "y").otherwise(F.col("html")))
    a, b = warc.manifest(warc.records(pages)), warc.manifest(warc.records(copy))
    first, second = warc.trees(a), warc.trees(b)
    assert [t.count() for t in first] == [3000, 3 * 64 - 4, 3 * 4, 3]
    assert {(r.file, r.leaf) for r in warc.suspects(first, second).collect()} == {(0, 5), (1, 2000 - 1024)}
    roots = {r.file: (r.begin, r.end) for r in first[-1].collect()}
    ends = {r.file: r.e for r in a.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("e")).collect()}
    assert roots == {f: (0, e) for f, e in ends.items()}


# ---------------------------------------------------------------- 8 packing


def test_packing(spark, mixed_docs):
    from tokenizers import Tokenizer

    odd = docs_of(spark, "It's DON'T naïve!! a***b <|endoftext|> ﬁ Ǆ İ ß é 12,345 ", "…", None, "", "a" * 5000, "x.", "\x01 y", "É, ç: ñ!", "'s' 't", "µ ª")
    docs = odd.unionByName(mixed_docs.select(*odd.columns).withColumn("doc_id", F.col("doc_id") + 1000))
    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = packing.pack(docs).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096 for r in rows)
    seen = collections.Counter()
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert bytes(r.ids) == np.array(own, dtype="<u4").tobytes() and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
    assert all(seen[k] % len(v) == 0 and seen[k] for k, v in ids.items())
    assert packing.pack(empty(spark)).count() == 0


def test_packing_with_a_cased_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["The Cat  sat\n on IT.", "", "ÉTÉ!! x"]
    assert packing.by_words(packing.default_vocabulary()) and not packing.by_words(path)
    got = collections.defaultdict(bytes)
    for r in packing.pack(docs_of(spark, *texts), vocabulary=path).orderBy("doc_id", "start").collect():
        got[r.doc_id] += bytes(r.ids)
    assert {k: np.frombuffer(v, dtype="<u4").tolist() for k, v in got.items()} == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}


def test_piece_lengths():
    for n in (1, 2, 4095, 4096, 4097, 12345):
        assert sum(packing.piece_lengths(n)) == n


# ---------------------------------------------------------------- 9 simhash


def test_golay_keys():
    rng = np.random.default_rng(9)
    w = rng.integers(0, 1 << 23, 3000)
    keys = golay.fuzzy_keys(w)
    one = golay.decode(w ^ (1 << rng.integers(0, 23, 3000)))[0]
    assert (keys == one[:, None]).any(1).all()
    assert set((keys >= 0).sum(1).tolist()) == {1, 6}


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark, mixed_docs):
    got = simhash.fingerprints(mixed_docs.where("doc_id <> 0")).join(mixed_docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.fp % (1 << 64) == plain_fingerprint(r.text) for r in got)
    assert simhash.fingerprint("One  two") == plain_fingerprint("one two") and simhash.fingerprint("") == 0


def test_components_equal_brute_force(spark):
    rng = random.Random(10)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(500):
        f = rng.choice(fps)
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in df.join(simhash.components(df), "fp").collect()}
    assert got == {i: find(i) for i in range(len(fps))}


def test_drop_near_duplicates(spark, mixed_docs):
    clash = mixed_docs.withColumn("__simhash_fp", F.lit("mine"))
    assert simhash.drop_near_duplicates(clash).columns == clash.columns
    kept = simhash.drop_near_duplicates(mixed_docs)
    rows = kept.collect()
    assert kept.columns == mixed_docs.columns
    assert sorted(r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 60) == list(range(60))
    assert [r.doc_id for r in rows if not (r.text or "").strip()] == [100]
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0 and simhash.near_duplicates(empty(spark)).count() == 0


# ---------------------------------------------------------------- 10 jpeg


def plain_decode(stream):
    """One bit at a time: the zigzag coefficients of a one-component image with a restart after every block."""
    f = jpeg.parse(stream)
    spec = f.huffman[0x10]
    codes, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            codes[length, code] = spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    out = []
    for seg in re.split(rb"\xff[\xd0-\xd7]", stream[f.data : -2]):
        bits = iter("".join(f"{b:08b}" for b in seg.replace(b"\xff\x00", b"\xff")))
        block = []
        while len(block) < 64:
            n, c = 0, 0
            while (n, c) not in codes:
                n, c = n + 1, c * 2 + int(next(bits))
            size = codes[n, c]
            raw = int("".join(next(bits) for _ in range(size)), 2)
            block.append(raw if raw >> (size - 1) else raw - (1 << size) + 1)
        out.append(block)
    return np.array(out)


def test_jpeg_round_trip(spark, mixed_docs):
    rng = random.Random(11)
    payloads = [jpeg.padded(bytes(rng.getrandbits(8) for _ in range(rng.randint(0, 700)))) for _ in range(40)] + [b"\xff" * 640, jpeg.padded(b"")]
    streams = jpeg.store(payloads)
    for p, s, (f, v, e) in zip(payloads, streams, jpeg.decoded(streams)):
        assert e is None and jpeg.stored_payload(f, v) == p
    f, v, _ = next(jpeg.decoded(streams[:1]))
    assert (plain_decode(streams[0]) == v.reshape(-1, 64)).all()
    got = jpeg.digests(jpeg.text_to_jpeg(mixed_docs)).join(mixed_docs.select("doc_id", "text"), "doc_id").where("doc_id > 0").collect()
    for r in got:
        p = jpeg.padded((r.text or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert jpeg.digests(jpeg.text_to_jpeg(empty(spark))).count() == 0


def test_broken_streams_get_errors(spark):
    good = jpeg.store([jpeg.padded(b"hello")])[0]
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"nonsense")), (4, bytearray(good[:60])), (5, bytearray(good.replace(b"\xff\xc0", b"\xff\xc2")))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("media", T.BinaryType())]))
    got = {r.doc_id: r for r in jpeg.image_features(df).collect()}
    assert bytes(got[1].payload) == jpeg.padded(b"hello") and got[1].error is None and (got[1].width, got[1].height) == (8, 8)
    assert all(got[k].error and got[k].width is None for k in (2, 3, 4, 5))


def test_decodes_runs_and_sampling():
    """A 4:2:0 image without restarts, with end-of-block and runs, written here bit by bit."""
    dc = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7 + list(range(12)))
    ac = bytes([0, 1, 2, 2, 1, 1] + [0] * 10 + [0x01, 0x00, 0x11, 0x02, 0x21, 0xF0, 0x03])

    def codes(spec):
        out, code, at = {}, 0, 16
        for n in range(1, 17):
            for _ in range(spec[n - 1]):
                out[spec[at]] = f"{code:0{n}b}"
                code, at = code + 1, at + 1
            code <<= 1
        return out

    d, a = codes(dc), codes(ac)
    amp = lambda v, s: f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else ""
    bits, last, want, rng = "", [0, 0, 0], [], random.Random(12)
    for _ in range(2):
        unit = []
        for part in (0, 0, 0, 0, 1, 2):
            level = rng.randint(-60, 60)
            s = abs(level - last[part]).bit_length()
            bits += d[s] + amp(level - last[part], s)
            last[part] = level
            block = [level] + [0] * 63
            block[1], block[3], block[22] = 1, -1, 1
            bits += a[0x01] + "1" + a[0x11] + "0"
            bits += a[0xF0] + a[0x21] + "1" + a[0x00]
            unit.append(block)
        want.append(unit)
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00")
    sof = struct.pack(">BHHB", 8, 16, 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    parts = [jpeg._segment(0xDB, b"\0" + b"\x08" * 64), jpeg._segment(0xC0, sof), jpeg._segment(0xC4, b"\x00" + dc), jpeg._segment(0xC4, b"\x10" + ac), jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))]
    f, v, error = next(jpeg.decoded([b"\xff\xd8" + b"".join(parts) + data + b"\xff\xd9"]))
    assert error is None and np.array_equal(v, np.array(want))
    assert jpeg.luminance(f, v).shape == (2, 4)


# ---------------------------------------------------------------- pipeline


def test_pipeline_equals_the_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(langid.training_rows(docs))
    rows = [r for r in docs.collect() if (p := model.predict(r.text)) and p[0] != "und" and p[1] >= 0.34]
    good = {r.doc_id for r in fertility.with_verdicts(spark.createDataFrame(rows, docs.schema)).where("kept").collect()}
    rows = [r for r in rows if r.doc_id in good]
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    left, kept = sorted(fps), set()
    while left:
        group, grown = {left[0]}, True
        while grown:
            more = {k for k in left if k not in group and any((fps[k] ^ fps[g]).bit_count() <= 3 for g in group)}
            grown, group = bool(more), group | more
        kept.add(min(group))
        left = [k for k in left if k not in group]
    got = corpus_pipeline.run(spark, small).toPandas()
    assert set(got.doc_id) == kept
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()


def test_pipeline_edges(spark, mixed_docs, tmp_path):
    """Null, empty, wordless, very long and repeated texts, null ids, columns with clashing names, and no rows at all."""
    import corpus_pipeline

    for name, docs in (("odd", mixed_docs.withColumn("__simhash_fp", F.lit(1)).withColumn("mixture_position", F.lit("mine"))), ("none", empty(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").toPandas()
        assert (name == "none") == got.empty
        if name == "odd":
            assert set(got.columns) == set(packing.digest(empty(spark)).columns)
            assert got.doc_id.isna().any() and not got.doc_id.isin([100, 101, 102]).any() and got.sequence_id.is_unique


def test_pipeline_sequences_follow_the_mixture(spark, small, tmp_path):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").where(F.col("doc_id").isin([int(k) for k in got.doc_id.unique()]))
    order = {r.doc_id: (r.slot, r.in_block) for r in mixing.schedule(docs).collect()}
    for _, bucket in got.sort_values("sequence_id").groupby("length"):
        seen = [order[k] for k in bucket.doc_id]
        assert seen == sorted(seen)
    # documents of one length: each bucket takes the sources by their target weights, to less than one block
    rows = [(i, "house tree water", "en", "b" if i % 10 == 9 else "a", 1) for i in range(6000)]
    corpus_pipeline.mixture(spark, spark.createDataFrame(rows, DOCS), small).write.parquet(f"{tmp_path}/mixture")
    got = corpus_pipeline.packed(spark, spark.read.parquet(f"{tmp_path}/mixture"), small).toPandas().sort_values("sequence_id")
    weight = 1 / (1 + (600 / 5400) ** mixing.TEMPER)
    for _, bucket in got.groupby("length"):
        run = np.cumsum(bucket.doc_id.to_numpy() % 10 != 9)
        n = np.arange(1, len(run) + 1)
        assert len(n) == 6000 and np.abs(run - n * weight)[: int(600 / (1 - weight)) - 8].max() < 2 * mixing.BLOCK_DOCS
