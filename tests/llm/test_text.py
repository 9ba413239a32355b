import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.llm import bpe, packing, quality, textstats

tiktoken = pytest.importorskip("tiktoken")
ODD = ["", None, " ", "\n\n", "héllo  wörld's 12 34", "<|endoftext|> a", "家族の台所です。", "\U0001f600\U0001f468‍\U0001f469", "\x00\x01�", "a" * 5000, " " * 300 + "x", "don't we'LL", "ab" * 3000]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(open(bpe.VOCABULARY, "rb").read()))


def test_ids_are_exact(encoder, reference):
    rng = random.Random(1)
    pools = ["abcdefgh etaoin", "aäöüß éè", "家族の台所ですABC ", "0123456789.,- ", "\n\t  x!?'\"<>|", "".join(chr(rng.randint(33, 0x2FF)) for _ in range(80))]
    texts = [t for t in ODD if t] + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    for t in texts:
        assert encoder.encode(t) == reference.encode_ordinary(t)
        assert encoder.count(t) == len(encoder.encode(t))
        assert encoder.vocabulary.decode(encoder.encode(t)).decode() == t


def test_every_token_stands_for_itself(encoder):
    v = encoder.vocabulary
    for i in random.Random(2).sample(range(v.size), 3000):
        assert v.encode_bytes(v.tokens[i]) == [i]
    assert all(v.halves[i][0] != i for i in range(256, v.size))


def test_corpus_round_trip(spark, encoder):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = bpe.encode_corpus(df)
    assert out.columns == ["doc_id", "ids"]
    by = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert by == {k: encoder.encode(t) for k, t in enumerate(ODD)} and by[0] == by[1] == []
    assert {r["doc_id"]: r["text"] for r in bpe.decode_corpus(out).collect()} == {k: t or "" for k, t in enumerate(ODD)}
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert bpe.count_tokens(df).agg(F.sum("n_tokens")).head()[0] == sum(map(len, by.values()))


# --- packing -------------------------------------------------------------------------------------------------------


def brute(sizes, capacity):
    """The rule by its definition: try every open container, and a new one."""
    gaps, out = [], []

    def squares(gs):
        return sum(sum(1 for g in gs if g == h) ** 2 for h in range(1, capacity))

    for s in sizes:
        best = None
        for k in [*sorted({g: k for k, g in enumerate(gaps) if g >= s}.items()), (capacity, None)]:
            after = list(gaps)
            if k[1] is None:
                after.append(capacity - s)
            else:
                after[k[1]] -= s
            cost = squares(after)
            if best is None or cost < best[0]:
                best = (cost, k[1], after)
        gaps = best[2]
        out.append(squares(gaps))
    return out, len(gaps)


def test_packing_follows_the_rule():
    rng = random.Random(4)
    for _ in range(20):
        sizes = [rng.randint(1, 12) for _ in range(60)]
        p = packing.SumOfSquares(12)
        costs = []
        for s in sizes:
            p.put(s)
            costs.append(int(sum(x * x for x in p.count[1:12])))
        want, n = brute(sizes, 12)
        assert costs == want and p.containers == n


def test_containers_hold_whole_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 300)
    rng = random.Random(6)
    items = [(k, rng.choice([0, None, rng.randint(1, 100), rng.randint(90, 350)])) for k in range(2000)] + [(1, 30), (None, 40)]
    df = spark.createDataFrame(items, "i long, n long")
    out = packing.pack(df, "i", "n", 100).collect()
    total = sum(n or 0 for _, n in items)
    assert sum(r["size"] for r in out) == total
    held = {}
    for r in out:
        assert (r["container_id"] is None) == (r["size"] == 0)
        if r["size"]:
            held[r["container_id"]] = held.get(r["container_id"], 0) + r["size"]
    assert max(held.values()) <= 100 and len(held) <= total / 100 * 1.05 + 3
    by = {}
    for r in out:
        by.setdefault(r["i"], []).append(r)
    for k, n in items[2:2000]:
        pieces = by[k]
        assert sum(p["size"] for p in pieces) == (n or 0) and len(pieces) == max(1, -(-(n or 0) // 100))
    assert packing.pack(df.limit(0), "i", "n", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "i", "n", 0)


# --- quality -------------------------------------------------------------------------------------------------------

COMMON = frozenset("the a of to in is was and that it with for on we they he she this every".split())
PROSE = "The doctor of the village was glad that we came to the house in the evening. It is a good place for this, and they know it."


@pytest.mark.parametrize(
    "text, statistic, low, high",
    [
        (PROSE, "sentence_lines", 1, 1),
        (PROSE, "punctuated_lines", 1, 1),
        ("Home\nAbout\nContact us.", "short_lines", 1, 1),
        ("a\t1\t2\nb\t3\t4", "cell_lines", 1, 1),
        ("x = {1: [2]};", "bracket_ratio", 0.4, 0.6),
        ("one two one two one two", "distinct_pairs", 0.4, 0.4),
        ("the of to", "common_words", 1, 1),
        ("a1 b2 c 3", "mixed_tokens", 0.5, 0.5),
        ("- one\n- two\nthree", "marked_lines", 0.6, 0.7),
        ("東京は大きい。", "ideographs", 0.8, 0.9),
        ("again " * 500, "compressed", 0, 0.05),
        (" \n\t", "n_words", 0, 0),
    ],
)
def test_statistics_of_text(text, statistic, low, high):
    s = dict(zip(textstats.NAMES, textstats.statistics(text, COMMON)))
    assert low <= round(s[statistic], 3) <= high


@pytest.mark.parametrize("parts", [1, 7])
def test_tails_are_exact(spark, parts):
    rng = np.random.default_rng(1)
    data = [(k % 3, "ab"[k % 2], float(round(x, 1))) for k, x in enumerate(rng.normal(size=1500))] + [(1, "d", 1.0)] * 900 + [(2, "d", 1.0)] * 10 + [(2, "d", 2.0)] * 700 + [(0, "e", None)]
    data = [(i, *r) for i, r in enumerate(data)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        out = {(r["id"], r["stat"]): (r["low"], r["high"]) for r in quality.tails(spark.createDataFrame(data, "id long, stat int, lang string, v double").repartition(5), "id").collect()}
        assert quality.tails(spark.createDataFrame([], "id long, stat int, lang string, v double"), "id").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(data) - 1
    for i, s, g, v in data[:-1:7]:
        same = [x for _, t, h, x in data if (t, h) == (s, g)]
        assert out[i, s] == pytest.approx((sum(x <= v for x in same) / len(same), sum(x >= v for x in same) / len(same)))


def _page(kind, rng):
    word = lambda: "".join(rng.choice(["ba", "do", "ne", "ri", "lo", "ta"]) for _ in range(rng.randint(2, 3)))
    if kind == "prose":
        return "\n".join(" ".join(f"the {word()} of the {word()} was in the {word()}" for _ in range(2)).capitalize() + "." for _ in range(rng.randint(3, 9)))
    if kind == "list":
        return "\n".join(f"{word().title()} {word()}" for _ in range(rng.randint(5, 20)))
    if kind == "table":
        return "\n".join("\t".join([word(), *(str(rng.randint(1, 999)) for _ in range(4))]) for _ in range(rng.randint(4, 12)))
    return "\n".join(f"{word()}({word()}){{return {word()}[{rng.randint(1, 9)}];}}" for _ in range(rng.randint(4, 12)))


def _corpus(spark, n):
    rng = random.Random(9)
    kinds = [["prose", "prose", "prose", "list", "table", "junk"][k % 6] for k in range(n)]
    rows = [(k, _page(kind, rng), ["en", None, "EN-gb", "nl"][k // 6 % 4], 5) for k, kind in enumerate(kinds)]
    return kinds, spark.createDataFrame(rows, "doc_id long, text string, lang string, kind int").drop("kind"), spark.createDataFrame([("en", w) for w in COMMON] + [("en", None)], "lang string, word string")


def test_scores_tell_kinds_of_pages_without_labels(spark):
    kinds, docs, common = _corpus(spark, 360)
    extra = spark.createDataFrame([(1000, "", "en"), (1001, None, None), (1002, " \n ", "und"), (1003, "long " * 100_000, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, kinds[k], "x") for k in range(0, 360, 5)] + [(5, "junk" if kinds[5] != "junk" else "list", "y"), (7, "?", "z"), (None, "junk", "z"), (77777, "junk", "z")], "doc_id long, kind string, annotator string")
    described = quality.describe(docs.unionByName(extra), common)
    out = {r["doc_id"]: r for r in quality.score(described, labels).collect()}
    assert len(out) == 364 and all(out[k]["kind"] is None and out[k]["score_junk"] is None for k in (1000, 1001, 1002)) and out[1003]["kind"] is not None
    held_out = [k for k in range(360) if k % 5]
    assert sum(out[k]["kind"] == kinds[k] for k in held_out) >= 0.95 * len(held_out)
    assert {r["lang"] for r in out.values()} == {"en", "und", "nl"}
    short = {r["doc_id"]: r["kind"] for r in quality.score(described, labels, with_tails=False).collect()}
    assert all(short.get(k) == r["kind"] for k, r in out.items())
    assert all(r["kind"] is None for r in quality.score(described, labels.limit(0)).collect())  # nothing but the scores decides
    assert quality.score(quality.describe(docs.limit(0), common), labels).count() == 0


def test_without_scores_no_page_is_found(spark, monkeypatch):
    kinds, docs, common = _corpus(spark, 120)
    labels = spark.createDataFrame([(k, kinds[k]) for k in range(0, 120, 2)], "doc_id long, kind string")
    tails = quality.tails
    monkeypatch.setattr(quality, "tails", lambda v, i: tails(v, i).withColumns({"low": F.lit(1.0), "high": F.lit(1.0)}))
    out = [r["kind"] for r in quality.score(quality.describe(docs, common), labels).collect()]
    assert len(set(out)) == 1
