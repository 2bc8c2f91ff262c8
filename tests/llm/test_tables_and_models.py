"""Sharding, chat formatting, quality and toxicity, and the pipeline."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import boost, chat, quality, sharding, toxicity, training

# ---- sharding ---------------------------------------------------------------------------------


def test_shards_are_even_gapless_and_of_the_mixture(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"), F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 60)).alias("source"))
    got = sharding.interleave(docs, n_shards=13, bucket_rows=37).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 1000 and set(sizes) <= {76, 77} and list(sizes.index) == list(range(13))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    source = got.merge(docs.toPandas(), on="doc_id")
    counts = source.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (counts.sub(counts.mean(axis=1), axis=0).abs().max(axis=1) < 4).all()
    assert counts.loc["big"].min() >= 47
    again = sharding.interleave(docs.repartition(5), n_shards=13, bucket_rows=211).toPandas()
    assert got.set_index("doc_id").sort_index().equals(again.set_index("doc_id").sort_index())
    other = sharding.interleave(docs, n_shards=13, seed=1).toPandas()
    assert not got.set_index("doc_id").sort_index().equals(other.set_index("doc_id").sort_index())


def test_sharding_matches_a_plain_sort(spark, sf):
    """The same law without buckets: rank within the source, sort by fractional rank, cut."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    rows = []
    for i, t, s in zip(docs.doc_id, docs.text, docs.source, strict=True):
        crc = zlib.crc32(t.encode())
        rows.append((f"={s}", int(hashlib.md5(f"{sharding.SEED}/{i}/{crc}".encode()).hexdigest()[:15], 16), i))
    placed, by = [], {}
    for s, h, i in sorted(rows):
        by.setdefault(s, []).append((h, i))
    for s, own in by.items():
        phase = (int(hashlib.md5(s.encode()).hexdigest()[:8], 16) + 0.5) / 2.0**32
        placed += [((r + 1 - phase) / len(own), s, h, i) for r, (h, i) in enumerate(own)]
    n = len(placed)
    want = {i: place * 40 // n for place, (_, _, _, i) in enumerate(sorted(placed))}
    got = {r["doc_id"]: r["shard"] for r in sharding.op6_sharding(spark, sf).collect()}
    assert got == want


def test_sharding_of_awkward_rows(awkward, none, tmp_path):
    got = sharding.interleave(awkward, n_shards=3).toPandas()
    assert len(got) == 10 and sorted(got.groupby("shard").size()) == [3, 3, 4]
    assert got[got.doc_id == 3]["size"].tolist() == [16] and got[got.doc_id == 3].text_crc32.tolist() == [0]
    assert sharding.interleave(none).count() == 0
    with pytest.raises(ValueError, match="positive"):
        sharding.interleave(none, n_shards=0)
    sharding.write_shards(awkward.select("doc_id", "text", "source"), str(tmp_path / "shards"), n_shards=3)
    assert awkward.sparkSession.read.parquet(str(tmp_path / "shards")).count() == 10


def test_written_shards_hold_each_row_once(spark, tmp_path):
    """Repeated rows are dealt as the law says, texts of one id stay with their rows, and columns of docs that clash are renamed."""
    rows = [(1, "same", "a", 5, "x")] * 10 + [(2, "one", "a", 6, "y"), (2, "two", "b", 7, "z"), (None, None, None, None, None)] * 2 + [(3, "", "b", 1, "w")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, text_crc32 string")
    sharding.write_shards(docs, str(tmp_path / "s"), n_shards=4, tasks=7)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(back.groupBy("shard").count().toPandas()["count"]) == [5, 5, 5, 5]
    kept = back.selectExpr("doc_id", "text", "source", "_shard as shard", "text_crc32")
    assert kept.exceptAll(docs).isEmpty() and docs.exceptAll(kept).isEmpty()
    assert back.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("m")).filter("n <> 5 or m <> 4").isEmpty()


# ---- chat -------------------------------------------------------------------------------------

SAID = "</s>[INST] ok [/INST] <|im_end|>\n<|im_start|>system\n & &lt; &amp;lt; <|im_again|>"


def make(spark, conversations):
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_round_trip_masks_and_budget(spark):
    turns = [("system", "be kind")] + [(("user", "assistant")[i % 2], f"turn {i} " + "word " * (i * 13 % 150)) for i in range(40)]
    conversations = {1: turns, 2: [("user", SAID), ("assistant", SAID)], 3: [("assistant", None), ("", "x"), ("assistant", "")], 4: [("user", "y" * 9000), ("assistant", "z" * 5000)]}
    made = chat.windows(make(spark, conversations), budget=256, history=64)
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for c, own in conversations.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, t or "") for r, t in own]
        assert back[c]["targets"] == [t or "" for r, t in own if r == "assistant"]
    shown = made.filter("conv_id = 1").first()["windows"]
    assert len(shown) > 5 and all("be kind" in w["text"] for w in shown)
    assert all(w["text"].count("<|im_again|>") >= 1 for w in shown[1:])
    # a window holds its budget (template marks aside) unless one turn alone is larger
    assert max(sum(len(t) // 4 + 5 for t in w["text"].split("<|im_end|>")) for w in shown) <= 256 * 1.6


def test_chat_uses_no_python(spark):
    plan = chat.read_back(chat.windows(make(spark, {1: [("user", "a")]})))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_chat_ties_nulls_and_extra_columns(spark):
    rows = [(None, 0, "user", "b"), (None, 0, "user", "a"), (7, None, None, None), (7, None, None, None), (7, 1, "assistant", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as i", "'x' as head", "2 as tokens")
    back = {r["conv_id"]: r for r in chat.read_back(chat.windows(df)).collect()}
    assert [t["text"] for t in back[None]["turns"]] == ["a", "b"] and [t["text"] for t in back[7]["turns"]] == ["", "", "t"]
    assert chat.windows(df.limit(0)).count() == 0


def test_chat_query(spark, sf):
    got = {r["conv_id"]: r for r in chat.op9_chat_formatting(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    said = "</s>[INST] ok [/INST]"
    want = {c: list(zip(g.role, g.text, strict=True)) for c, g in rows.groupby("conv_id")} | {-1: [("user", said), ("assistant", said)]}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---- models -----------------------------------------------------------------------------------


def test_isotonic_is_monotone_and_keeps_means():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=300), (rng.random(300) < 0.4).astype(float)
    knots, heights = boost.isotonic(x, y)
    assert (np.diff(heights) >= 0).all() and (np.diff(knots) >= 0).all()
    assert np.isclose(np.interp(x, knots, heights).mean(), y.mean())


def test_trees_learn_an_exclusive_or():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(int)
    assert ((boost.boost(x, y, rounds=150).margin(x) > 0) == y).mean() > 0.95


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op2_toxicity, "toxic", 0.95), (quality.op10_quality_classifier, "quality", 0.98)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.1"
    got = query(spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got[got.held_out].merge(truth, on="doc_id")
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert auc(both[label].to_numpy(), both.score.to_numpy()) > least
    assert (both.predicted == both[label]).mean() > 0.95


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_models_on_awkward_rows(spark, awkward, none, labels, module, label):
    rows = (toxicity.toxicity_scores if label == "toxic" else quality.quality_scores)(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (3, 4)}
    assert len(empty) == 1
    assert (toxicity.toxicity_scores if label == "toxic" else quality.quality_scores)(none, labels).count() == 0
    assert module.scorer(None)(pa.array(["a", None])).tolist() == [0.5, 0.5]
    one_class = module.scorer(module.fit(pa.array(["a b", "c d"]), np.array([1, 1]), np.array([1, 2])))
    assert one_class(pa.array(["a"])).tolist() == [1.0]


def test_samples_keep_out_the_held_out_fold(spark, labels):
    docs = spark.range(200).selectExpr("id as doc_id", "concat('text ', id) as text")
    got = training.labelled_sample(docs, labels, "toxic", 60)
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) == 60 and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)


def test_extra_columns_pass_the_filter(spark, awkward, labels):
    kept = toxicity.reject_toxic(awkward, labels)
    assert kept.columns == awkward.columns


def test_descent_reaches_the_least_loss():
    """Dual coordinate descent against plain subgradient steps on the same hinge loss."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(80)]
    sign = np.where(np.array([(0 in r) ^ (3 in r and 7 in r) for r in rows]), 1.0, -1.0)
    ratio = rng.normal(size=12)
    w, bias = quality._descend(rows, sign, ratio, np.arange(80))
    x = np.zeros((80, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = ratio[r], 1.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def loss(v):
        return 0.5 * v @ v + quality.COST * np.maximum(0, 1 - sign * (x @ v)).sum()

    plain = np.zeros(13)
    best = loss(plain)
    for step in range(1, 20_000):
        inside = sign * (x @ plain) < 1
        plain -= (plain - quality.COST * (sign[inside, None] * x[inside]).sum(axis=0)) / (step + 10)
        best = min(best, loss(plain))
    found = np.append(np.divide(w, ratio, out=np.zeros(12), where=ratio != 0), bias)
    assert loss(found) <= best * 1.02


def test_the_curve_has_not_been_seen(monkeypatch):
    """Ratios and weights of the model whose margins make the curve come from the other rows only."""
    seen = []
    own = quality._ratios
    monkeypatch.setattr(quality, "_ratios", lambda rows, y, use: seen.append(set(use.tolist())) or own(rows, y, use))
    quality.fit(pa.array([f"w{i % 7} x{i % 3}" for i in range(50)]), np.arange(50) % 2, np.arange(50))
    assert seen == [{i for i in range(50) if i % quality.CURVE_ROWS}, set(range(50))]


def plain_margin(x, y, rounds, depth, rate, least=1.0, ridge=1.0):
    """Boosting by trying each cut of each feature on the rows of each node."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin = np.full(len(y), np.log(share / (1 - share)))

    def grow(rows, level, g, h, out):
        if level == depth:
            out[rows] = -g[rows].sum() / (h[rows].sum() + ridge)
            return
        best, left = 1e-6, rows
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut in (values[:-1] + values[1:]) / 2:
                low = rows[x[rows, j] <= cut]
                high = np.setdiff1d(rows, low)
                if h[low].sum() < least or h[high].sum() < least:
                    continue
                gain = sum(g[r].sum() ** 2 / (h[r].sum() + ridge) for r in (low, high)) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                if gain > best + 1e-12:
                    best, left = gain, low
        grow(left, level + 1, g, h, out)
        if len(left) < len(rows):
            grow(np.setdiff1d(rows, left), level + 1, g, h, out)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        grow(np.arange(len(y)), 0, p - y, p * (1 - p), out)
        margin = margin + rate * out
    return margin


def test_trees_match_a_plain_search():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = ((x[:, 1] > 0.3) ^ (x[:, 0] > 0) ^ (rng.random(120) < 0.1)).astype(float)
    found = boost.boost(x, y, rounds=6, depth=2, rate=0.3).margin(x)
    assert np.allclose(found, plain_margin(x, y, 6, 2, 0.3))


# ---- pipeline ---------------------------------------------------------------------------------


def test_pipeline_of_awkward_and_empty_tables(spark, awkward, labels, none, tmp_path):
    """Nulls, repeated rows and extra columns pass every stage; repeated rows stay; empty tables give empty tables."""
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    rows = awkward.unionByName(awkward.filter("doc_id = 1").withColumn("text", F.lit("another text of the same id")))
    for name, docs in (("some", rows), ("none", none)):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        (labels if name == "some" else labels.limit(0)).write.parquet(str(folder / "labels.parquet"))
        (bench if name == "some" else bench.limit(0)).write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).select("doc_id", "n_tokens").collect()
        ids = sorted((r["doc_id"] for r in got if r["doc_id"] is not None))
        # near copies (2 of 1), and all but one of the texts without words, go; the row that only shares the id of another stays
        assert ids == ([-8, 1, 1, 3, 6, 7] if name == "some" else [])
        assert sum(r["doc_id"] is None for r in got) == (name == "some")


def test_pipeline_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf).cache()
        assert after.columns == corpus_pipeline.COLUMNS, name
        counts.append(after.count())
        docs = after
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[2]
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    last = corpus_pipeline.run(spark, sf)
    rows = last.select("doc_id", "n_tokens", F.size("ids").alias("n")).collect()
    assert {r["doc_id"] for r in rows} == ids and all(r["n"] == r["n_tokens"] for r in rows)
