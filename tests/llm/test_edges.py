"""What every operator and stage must stand: nulls, empty and very long texts, repeated rows, empty tables, columns with clashing names."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, decontaminate, fixity, html_text, language, lm_scoring, near_dedup, packing, secrets, topk, toxicity

BYTES, WORDS, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
CLASHES = ("regs", "row", "bucket", "spans", "score", "words", "at", "seed", "part", "salt", "node", "hash", "n", "a", "b", "lang_pred", "_a", "_row", "_part", "links")
DOC = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)


def words(rng, n, letters="abcdefg"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(21)
    long = words(rng, 150_000)
    rows = [(i, words(rng, 40), "en" if i % 2 else "de") for i in range(12)] + [(20, long, "en"), (21, long, "en"), (22, None, "en"), (23, "", None), (24, " \n\t", "de"), (None, "no id on this row", "en"), (None, None, None), (3, None, None)]
    rows += [rows[5], rows[5], rows[6]]
    return spark.createDataFrame([(*r, *("x" for _ in CLASHES)) for r in rows], DOC)


def outcome(f, df):
    """Row counts over the odd table and over an empty one."""
    return f(df).count(), f(df.limit(0)).count()


def test_rows_in_rows_out(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(12)] + [(5, 7), (None, 1), (6, None)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 1

    def packed(df):
        return packing.packed(df, WORDS, 1 << 20).where("piece = 0")

    for f in (
        lambda df: secrets.secret_spans(df, BYTES), lambda df: secrets.redacted(df, BYTES), lambda df: near_dedup.near_duplicates(df, k=4), packed,
        lambda df: language.predicted(df, language.train(odd, F.lit(True), PIECES)), lambda df: toxicity.scored(df, toxicity.train(odd, labels, F.lit(True))), lambda df: lm_scoring.scored(df.select("doc_id", "text"), ~fold, fold),
        lambda df: html_text.extracted(df.withColumnRenamed("text", "html").withColumn("url", F.lit("u")), id_col="doc_id"),
    ):
        assert outcome(f, odd) == (n, 0)
    items = spark.createDataFrame([(1, words(random.Random(3), 20)), (2, None), (3, "")], "item_id long, text string")
    for df in (odd, odd.limit(0)):
        assert decontaminate.leaks(df, items).count() == 0 and decontaminate.leaks(df, items.limit(0)).count() == 0
        assert decontaminate.cleaned(df, items).count() == df.count()
    assert secrets.redacted(odd, BYTES).columns == odd.columns
    assert fixity.audit(odd, odd, "doc_id", ["text", "hash"]).count() == 0


def test_repeated_rows_have_equal_results(spark, odd):
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    for df in (secrets.digests(secrets.secret_spans(odd, BYTES)), near_dedup.near_duplicates(odd, k=4), lm_scoring.scored(odd.select("doc_id", "text"), ~fold, fold)):
        got = [tuple(r.asDict().values()) for r in df.where("doc_id = 5").collect()]
        assert len(got) == 3
        if "component_id" not in df.columns:
            assert len({tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got}) == 1
    near = near_dedup.near_duplicates(odd, k=4).where("doc_id in (20, 21)").collect()
    assert {r.component_id for r in near} == {20} and {r.doc_id: r.kept for r in near} == {20: True, 21: False}


# --- op1 -------------------------------------------------------------------------------------

TEXT = "The harbour office opens at nine and closes at five on most days of the week. "
HARD = {
    "letters that grow in lower case": ("<article><h1>T one</h1><p>" + "İ" * 60 + "</p><script>var a='</p>';</script><p>After the script.</p></article>", "T one " + "İ" * 60 + " After the script."),
    "quotes inside values": ("<article><p title=don't>One paragraph here.</p><p>Second one isn't lost.</p></article>", "One paragraph here. Second one isn't lost."),
    "nested dropped elements": ("<article><p>Hello there.</p><object><object></object>leak</object><p>Bye there.</p></article>", "Hello there. Bye there."),
    "no roles": (f"<body><div><h1>Plain title here</h1><p>{TEXT}</p><p>{TEXT * 2}</p></div></body>", f"Plain title here {TEXT}{TEXT * 2}"),
    "a layout table": (f"<table><tr><td><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></td><td><h1>Plain title here</h1><p>{TEXT}</p><p>{TEXT}</p></td></tr></table>", f"Plain title here {TEXT}{TEXT}"),
    "a header of the article's own": (f"<article><header><h1>My own title</h1></header><p>{TEXT}</p><p>{TEXT}</p></article>", f"My own title {TEXT}{TEXT}"),
    "comments in another language": (f"<article><h1>A title</h1><p>{TEXT}</p></article><div class='kommentare'><p>Das sehe ich aber ganz anders.</p></div>", f"A title {TEXT}"),
    "an unclosed control": (f"<article><p>{TEXT}</p><form><button>Send<option>x</form><p>{TEXT}</p></article>", f"{TEXT}{TEXT}"),
    "references and spaces": ("<article><p>A &amp;lt; b&nbsp;&eacute;\n\n c</p><p>Two<br>lines &#8364;</p></article>", "A &lt; b é c Two lines €"),
}


@pytest.mark.parametrize("name", HARD)
def test_hard_pages(name):
    page, want = HARD[name]
    assert " ".join(html_text.main_blocks(page, html_text.default_model())) == " ".join(want.split())


def test_pages_are_read_in_time_proportional_to_their_length():
    import time

    for part in ("<button>", "<option>", "<b>", "<div>", "</p>", "<p title='x", "<!--", "<a href=x ", "&amp;", "<li><ul>"):
        took = []
        for n in (4_000, 32_000):
            began = time.perf_counter()
            html_text.parse("<article>" + part * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 24 * took[0] + 0.2, (part, took)


def test_blocks_of_layouts_with_and_without_roles():
    model, found, right, all_ = html_text.default_model(), 0, 0, 0
    for page, good in html_text.labelled_pages(150, seed=1234):
        got = set(html_text.main_blocks(page, model))
        found, right, all_ = found + len(got), right + len(got & good), all_ + len(good)
    assert right / found > 0.97 and right / all_ > 0.97


# --- op2 -------------------------------------------------------------------------------------


def test_base_spans_equal_plain_patterns():
    import re

    rng = random.Random(5)
    parts = ["password", "Secret", "token=", "api_key", '"', ":", "=", " ", "é", "AKIA", "ABCDEF0123456789", "abcdef0123456789", "zz", "\n", "x.y/z", "AKIAZZ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert [s for s in secrets.find(text, BYTES) if s[1] < 3] == sorted(want), text


def test_planted_random_strings_are_found_and_names_are_not():
    import string

    rng = random.Random(6)
    kinds = {"base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "letters": string.ascii_letters}
    for name, letters in kinds.items():
        hit = 0
        for _ in range(300):
            run = "".join(rng.choice(letters) for _ in range(rng.randint(20, 44)))
            hit += (9, 3, 9 + len(run)) in secrets.find(f"words of {run} here", BYTES)
        assert hit >= 294, (name, hit)
    clean = """internationalization Rechtsschutzversicherungsgesellschaften getElementByIdAndClassName AbstractSingletonProxyFactoryBean chapter_12-section_3-part_4
/usr/lib/x86_64-linux-gnu/libcrypto 123e4567-e89b-12d3-a456-426614174000 2024-01-01-12-30-45-123456789 v1_2_3-20240101120000 MAX_NUMBER_OF_OPEN_CONNECTIONS d41d8cd98f00b204e9800998ecf8427E
00000000000000000000000000 src/main/java/com/example/service/UserService the-quick-brown-fox-jumps-over""".split()
    assert [t for t in clean if any(k == 3 for _, k, _ in secrets.find(t, BYTES))] == []


def test_runs_that_reach_beyond_named_spans_are_masked_whole(spark):
    run = "xK9qZ2vR7tLw4NpB8sYd30123456789abcdef0123qQ9z"
    assert {(k, a, b) for a, k, b in secrets.find(run, BYTES)} == {(3, 0, len(run)), (2, 19, 41)}
    df = spark.createDataFrame([(f"key {run} end",)], "text string")
    assert secrets.redacted(df, BYTES).first().text == "key [SECRET] end"


# --- op4 -------------------------------------------------------------------------------------


def test_numerals_are_no_letters_and_marks_belong_to_words():
    assert [language.cut(t) for t in ("½ ² ① Ⅷ", "a½b", "नमस्ते", "don't")] == [[], ["a", "b"], ["नमस्ते"], ["don", "t"]]
    pieces = language.pieces_of(PIECES)
    assert "▁international" in pieces and max(map(len, pieces)) > 13


def test_a_dirty_language_column_is_bounded(spark):
    df = spark.createDataFrame([(i, f"wort{'abc'[i % 3] * 3} text", f"l{i}" if i >= 60 else "de" if i % 2 else "en") for i in range(400)], "doc_id long, text string, lang string")
    langs, probs, _ = language.train(df, F.lit(True), PIECES, languages=2)
    assert langs == ["de", "en"] and probs.shape[0] == 2


# --- op5 -------------------------------------------------------------------------------------


def test_an_id_with_several_texts(spark):
    rng = random.Random(7)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, b + " more"), (3, c), (3, c), (None, c + " end"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, k=4).collect()
    assert len(got) == 7 and sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, 3), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4)]
    stay = near_dedup.deduplicated(df.withColumn("_row", F.lit("mine")), k=4).collect()
    assert sorted((r.doc_id, r.text or "") for r in stay) == [(1, a), (1, b), (3, c), (4, "")] and stay[0]["_row"] == "mine"
    assert near_dedup.deduplicated(df.limit(0)).count() == 0


def test_links_at_the_threshold_are_found(spark):
    rng = random.Random(8)
    rows, linked = [], 0
    for i in range(300):
        w = [f"w{rng.randrange(10**9)}" for _ in range(123)]
        x = list(w)
        x[-13:] = [f"v{rng.randrange(10**9)}" for _ in range(13)]  # 107 of 120 shingles stay: 107/133 = 0.805
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(x))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).where("doc_id % 2 = 1 and component_id = doc_id - 1").count()
    assert got == 300


# --- op6 -------------------------------------------------------------------------------------


def searched(x, asks, k=5):
    v = np.floor(256 * x)
    rows = np.arange(len(v))
    s = topk.Search(v[asks], rows[asks], k)
    for at in range(0, len(v), 2048):
        s.show(v[at : at + 2048], rows[at : at + 2048], rows[at : at + 2048])
    for q, own, score in zip(asks, s.other, s.score, strict=True):
        p = (v @ v[q]).astype(np.int64)
        want = [j for j in np.lexsort((rows, -p)) if j != q][:k]
        assert own.tolist() == want and score.tolist() == p[want].tolist()
    return (s.formed + s.bounded) / (len(asks) * len(v))


def test_pruning_saves_products_where_data_allow():
    rng = np.random.default_rng(3)
    asks = rng.choice(6000, 128, replace=False)
    assert searched(rng.normal(size=(6000, 2)), asks) < 0.5
    unit = rng.normal(size=(6000, 4))
    assert searched(unit / np.linalg.norm(unit, axis=1)[:, None], asks) < 0.6
    centers = rng.normal(size=(80, 64))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    assert searched(centers[rng.integers(0, 80, 6000)] + rng.normal(size=(6000, 64)) * 0.02, asks) < 0.4


def test_cover_trees_cover_and_separate():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(500, 3)) * 256, np.repeat(rng.normal(size=(1, 3)) * 256, 60, axis=0)])
    t = topk.cover_tree(x)
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for i in range(len(t.low)):
        own = x[t.order[t.low[i] : t.high[i]]]
        assert np.linalg.norm(own - t.center[i], axis=1).max() <= t.radius[i] + 1e-6
        if t.children[i]:
            kids = slice(t.child[i], t.child[i] + t.children[i])
            assert t.low[kids][0] == t.low[i] and t.high[kids][-1] == t.high[i] and (t.radius[kids] <= 2.0 ** (t.level[i] - 1) + 1e-3).all()
            c = t.center[kids]
            gaps = np.linalg.norm(c[:, None] - c[None], axis=2)[~np.eye(len(c), dtype=bool)]
            assert gaps.min(initial=np.inf) > 2.0 ** (t.level[i] - 1) - 1e-3


def test_many_regions_blocks_and_query_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 20)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 6)), 2)
    x[100:400] = x[7] + np.round(rng.normal(size=(300, 6)) * 0.01, 2)  # a third of all rows in one place
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, row string")
    v = np.floor(256 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 700, 10):
        s = v @ v[q]
        want += [(q, k + 1, j, s[j]) for k, j in enumerate([j for j in np.lexsort((np.arange(700), -s)) if j != q][:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.best_products(df, F.col("vec_id") % 10 == 0).collect()) == sorted(want)


# --- op7 -------------------------------------------------------------------------------------


def laid(docs, items):
    """Brute force: every way to lay an item over a document."""
    out = set()
    for d, text in docs:
        w = text.lower().split()
        for i, item in items:
            t = item.lower().split()
            for start in range(-len(t) + 1, len(w)):
                lo, hi = max(-start, 0), min(len(t), len(w) - start)
                size = min(decontaminate.STRETCH, len(t))
                agree = [w[start + j] == t[j] for j in range(lo, hi)]
                if t and any(sum(agree[j : j + size]) >= np.ceil(size * decontaminate.AGREE) for j in range(len(agree) - size + 1)):
                    out.add((d, i, start, sum(agree)))
    return out


@pytest.mark.parametrize("most", [250_000, 0])
def test_overlaps_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", most)  # 0: by shuffles
    rng = random.Random(9)
    letters = "abc"
    items = [(i, words(rng, rng.choice((1, 2, 3, 4, 5, 6, 7, 8, 11, 13, 20, 30)), letters + "defghij")) for i in range(40)]
    docs = []
    for d in range(120):
        w = words(rng, 20, letters).split()
        i, item = rng.choice(items)
        t = item.split()
        for j in range(len(t)):
            if rng.random() < rng.choice((0, 0.1, 0.25)):
                t[j] = "new"
        at = rng.randrange(len(w))
        docs.append((d, " ".join(w[:at] + t + w[at:])))
    docs += [docs[0]]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.start, r.matched) for r in got} == laid(docs, items) and len(got) == len({(r.doc_id, r.item_id, r.start) for r in got})


# --- op8 -------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizers_over_all_categories():
    import sys
    import unicodedata

    import pyarrow as pa

    by = {}
    for c in range(sys.maxunicode + 1):
        by.setdefault(unicodedata.category(chr(c)), []).append(chr(c))
    kinds = sorted(set(by) - {"Cs", "Cn", "Co"})
    rng, tok, texts = random.Random(10), packing.tokenizer(WORDS), []
    for _ in range(3000):
        texts.append("".join(rng.choice("abcXYZ ΟΔΣςσ'.İIß") if rng.random() < 0.5 else rng.choice(by[rng.choice(kinds)]) for _ in range(rng.randint(1, 40))))
    for t, ids in zip(texts, packing.token_ids(pa.array(texts), WORDS), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_certificates_come_with_the_pieces(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randint(1, 60))) for i in range(300)] + [(400, None), (401, None), (401, None)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 128).toPandas()
    assert (got["part_bound"] <= got["part_bins"]).all() and got["sequence_id"].nunique() <= got["part_bins"].sum()
    assert (got[got["doc_id"] >= 400]["ids_crc32"] == zlib.crc32(np.array([1], "<u4").tobytes())).all()


# --- op10 ------------------------------------------------------------------------------------


def test_counts_and_base_scores_by_document(spark, odd):
    import math
    from collections import Counter

    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    cut = lambda t: [*(w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if w), None]
    rows, learnt = odd.collect(), Counter()
    for r in rows:
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            learnt.update(cut(r.text))
    n, v = sum(learnt.values()), len(learnt)
    want = sorted((str(r.doc_id), r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(cut(r.text)), sum(learnt[w] > 0 for w in cut(r.text)), n, round(sum(math.log10((learnt[w] + 0.5) / (n + 0.5 * (v + 1))) for w in cut(r.text)), 4)) for r in rows)
    got = lm_scoring.scored(odd.select("doc_id", "text"), ~fold, fold).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


# --- shared ----------------------------------------------------------------------------------


def test_operators_at_once_leave_each_other_s_tables_alone(spark):
    from concurrent.futures import ThreadPoolExecutor

    rng = random.Random(12)
    frames = [spark.createDataFrame([(i, words(rng, 30)) for i in range(40)], "doc_id long, text string") for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda df: near_dedup.near_duplicates(df, k=4).count(), frames))
    assert got == [40, 40, 40]


def test_a_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.scratch_dir(Session())


# --- the pipeline ----------------------------------------------------------------------------


def test_each_stage_stands_odd_tables(spark, odd, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    spark.createDataFrame([(1, words(random.Random(77), 20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = odd.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, d)
            assert name == "best_fit_packing" or out.columns == docs.columns
            assert (out.count() > 0) == (df is docs)


def test_different_texts_of_one_id_stay(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    a, b, c = (words(rng, 50) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (1, b), (1, c), (2, b), (2, a + " now")], "doc_id long, text string")
    got = corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(1, a), (1, b), (1, c)])
    spark.createDataFrame([(7, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == sorted([(1, a), (1, c), (2, a + " now")])
