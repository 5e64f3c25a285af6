"""Texts with NUL, odd white space, number signs and open elements; and the query functions over the small tables."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import chat, fertility, jpeg, langid, mainhtml, mixing, packing, quality, simhash
from tests.llm.test_llm import plain_base, plain_fingerprint, plain_tokens

BITS = ["a", "Word", "ing", " ", "  ", "\n", "\0", "\0 ", " \0", "é", "文字", "\t", "\r\n", "\x0b", "x.", " 12", "\x1c", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "▁", "½", "²", "①"]


def test_fertility_of_odd_texts():
    rng = random.Random(31)
    texts = ["a \0 b", "\0", "a\0 a a\0", "a   b"] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    got = fertility.Meter()(texts)
    for i, text in enumerate(texts):
        assert plain_base(text) == tuple(got[c][i] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), text
        if i < 1500:
            for v, want in plain_tokens(text).items():
                assert np.allclose([got[f"{m}_{v}"][i] for m in ("n_tokens", "chars_per_token", "byte_share", "entropy_share")], want), (text, v)


def model_of(**texts):
    n = np.full((len(texts), langid.BUCKETS), 0.5)
    for row, text in zip(n, texts.values()):
        row += np.bincount(langid.hashed_ngrams(text), minlength=langid.BUCKETS)
    return langid.Model(tuple(texts), n / n.sum(1, keepdims=True))


def test_only_letters_have_a_language():
    model = model_of(de="das haus und der baum", en="the house and the tree")
    rng = random.Random(32)
    for _ in range(5000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))
        assert (model.predict(text)[0] == "und") == (not any(c.isalpha() for c in text)), text


def plain_mixture(model, text):
    """The same inference a number at a time."""
    grams, p = langid.hashed_ngrams(text).tolist(), model.table.tolist()

    def fit(langs):
        share = [1 / len(langs)] * len(langs)
        for _ in range(40 if len(langs) > 1 else 0):
            old, sums = share, [0.0] * len(langs)
            for g in grams:
                each = [s * p[k][g] for s, k in zip(share, langs)]
                for j, e in enumerate(each):
                    sums[j] += e / sum(each)
            share = [s / len(grams) for s in sums]
            if max(abs(a - b) for a, b in zip(share, old)) < 1e-3:
                break
        return share, sum(math.log(sum(s * p[k][g] for s, k in zip(share, langs))) for g in grams)

    langs = list(range(len(p)))
    share, value = fit(langs)
    if min(share) < 1e-3:
        langs = [k for k, s in zip(langs, share) if s >= 1e-3]
        share, value = fit(langs)
    while len(langs) > 1:
        fewer = [k for j, k in enumerate(langs) if j != share.index(min(share))]
        other, worse = fit(fewer)
        if (value - worse) / langid.NGRAM > 0.5 * math.log(max(len(grams) / langid.NGRAM, 2)):
            break
        langs, share, value = fewer, other, worse
    return {model.languages[k]: s for k, s in zip(langs, share)}


def test_mixture_equals_a_loop():
    words = {"de": "das haus und der baum wir gehen heute nicht", "en": "the house and the tree we walk today not", "fr": "la maison et le arbre nous allons pas aujourd"}
    model, rng = model_of(**{k: w * 5 for k, w in words.items()}), random.Random(33)
    for _ in range(40):
        langs = rng.sample(list(words), rng.randint(1, 3))
        text = " ".join(rng.choice(words[rng.choice(langs)].split()) for _ in range(rng.randint(1, 40)))
        got, want = model.proportions(text), plain_mixture(model, text)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("unit", ["<option>word value ", '<a "', "<a '>w ", "<a ", "<svg>a<b>", "<!-- ", "<b>word ", "<script>x", "<p>a </p"])
def test_pages_take_time_in_proportion(unit):
    page = unit * (1_000_000 // len(unit))
    begin = time.process_time()
    assert sum(len(p[0]) for p in mainhtml.pieces(page)) <= len(page)
    assert time.process_time() - begin < 3
    begin = time.process_time()
    mainhtml.Page(page[:250_000])
    assert time.process_time() - begin < 3


def test_open_elements():
    words = lambda page: " ".join(t for c, t in zip(*(lambda p: (p.context, p.text))(mainhtml.Page(page))) if c).split()
    assert words("<p>x</p><script>var a = '<p>'; <b>code</b>") == ["x"]
    assert words("<p>x</p><style>p {} <p>y") == ["x"]
    assert words("<option>one<option>two<p>x") == ["one", "two", "x"]
    assert words("<SCRIPT>a</Script ><p>x<title>t</title>y") == ["x", "y"]
    assert words('<p class="a>b">t</p><a title="q>r s') == ["t", "r", "s"]


def frame(df, key="doc_id"):
    return df.toPandas().sort_values(key).reset_index(drop=True)


def test_language_query(spark, small):
    docs, got = frame(spark.read.parquet(f"{small}/documents.parquet")), frame(langid.op2_language(spark, small))
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    known = got.held_out & docs.lang.notna() & (got.lang_pred != "und")
    assert (got.lang_pred == docs.lang)[known].mean() > 0.95
    assert ((got.lang_pred == "und") == [not any(map(str.isalpha, t or "")) for t in docs.text]).all()


def test_language_query_learns_from_no_held_out_text(spark, small, tmp_path):
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.withColumns({"lang": F.when(held, "zz").otherwise(F.col("lang")), "source": F.lit("y")}).write.parquet(f"{tmp_path}/documents.parquet")
    assert frame(langid.op2_language(spark, small)).equals(frame(langid.op2_language(spark, str(tmp_path))))


def test_rules_simhash_packing_and_media_queries(spark, small):
    docs = frame(spark.read.parquet(f"{small}/documents.parquet"))
    rules = frame(fertility.op4_fertility(spark, small))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert [tuple(r) for r in rules[names].itertuples(index=False)] == [plain_base(t) for t in docs.text]
    assert not (rules.kept & rules.base_failed).any() and rules.kept.mean() > 0.5
    prints = frame(simhash.op9_simhash(spark, small))
    assert prints.fingerprint.tolist() == [f"{plain_fingerprint(t):016x}" for t in docs.text]
    pieces = packing.op8_pack(spark, small).toPandas()
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all() and set(pieces.doc_id) == set(docs.doc_id)
    media = frame(jpeg.op10_jpeg(spark, small))
    for r, text in zip(media.itertuples(), docs.text):
        raw = (text or "").encode()
        whole = jpeg.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    mixed = mixing.op3_mixing(spark, small).toPandas()
    assert sorted(mixed.doc_id) == docs.doc_id.tolist()


def test_page_and_chat_queries(spark, small):
    pages = mainhtml.op5_html(spark, small).toPandas()
    assert (pages.n_chars == pages.text.map(len)).all() and len(pages) == spark.read.parquet(f"{small}/pages.parquet").count()
    assert not any(t != " ".join(t.split()) for t in pages.text)
    got = {r.conv_id: r for r in chat.op6_chat(spark, small).collect()}
    rows = sorted((r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{small}/conversations.parquet").collect())
    probe = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    for c in got:
        turns = [(role, text) for k, _, role, text in rows if k == c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(got) == {r[0] for r in rows}


def test_temperature_calibrates():
    rng = np.random.default_rng(34)
    for true in (0.2, 1.0, 5.0):
        raw = rng.normal(size=20_000) * 4
        y = (rng.random(20_000) < 1 / (1 + np.exp(-raw / true))).astype(float)
        found = quality.fit_temperature(raw, y)
        assert abs(found / true - 1) < 0.1
        p = 1 / (1 + np.exp(-raw / found))
        for low in (0.1, 0.3, 0.5, 0.7, 0.9):
            near = np.abs(p - low) < 0.05
            assert abs(y[near].mean() - p[near].mean()) < 0.06
    raw = np.concatenate([rng.uniform(-9, -1, 100), rng.uniform(1, 9, 100)])
    assert 0.01 < quality.fit_temperature(raw, (raw > 0).astype(float)) < 5  # told apart without an error
    assert 0.001 <= quality.fit_temperature(np.zeros(0), np.zeros(0)) <= 1000
