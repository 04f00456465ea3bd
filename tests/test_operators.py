"""Operators against hand-made rows and independent restatements of the sequential ones."""

import hashlib
import json
import random
import tarfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamellar import schemas
from lamellar.functions import filters, scalars
from lamellar.operators import acquire, encode, facets, hierarchy, imaging, labels, leaderboard, lookups, metrics, pooling, presence, probe, selection
from lamellar.plans.dataset import Build, Config, compute_line, env_config, setting
from lamellar.sources import entities, files, rest, results, transfer
from lamellar.streaming.files import process_new, windowed_counts


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


# ---- scalars


def test_truthy_and_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["True", "1", " yes ", "t", "no", "", None]], "v string")
    assert [r[0] for r in df.select(scalars.truthy(F.col("v"))).collect()] == [True] * 4 + [False] * 3
    df = spark.createDataFrame([("0", ""), ("1.0", None), ("0.5", "0"), (None, ""), ("x", ""), ("2", "x")], "a string, b string")
    assert [r[0] for r in df.select(scalars.any_of(F.col("a"), F.col("b"))).collect()] == [0, 1, 0, None, 0, 1]
    assert [r[0] for r in df.select(scalars.as_int(F.col("a"))).collect()] == [0, 1, 0, None, None, 2]


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("/a/b__c__x512_y0.jpg",), ("plain.png",), ("x__y",)], "p string")
    assert [r[0] for r in df.select(scalars.item_key(F.col("p"))).collect()] == ["b", "plain", "x"]
    x, y = scalars.patch_xy(F.col("p"))
    assert [tuple(r) for r in df.select(x, y).collect()] == [(512, 0), (None, None), (None, None)]
    n = spark.createDataFrame([(0.1234,), (None,), (float("nan"),)], "v double")
    assert [r[0] for r in n.select(scalars.three_places(F.col("v"))).collect()] == ["0.123", "-", "-"]
    s = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>")
    p, k = s.select(scalars.softmax(F.col("v")), scalars.argmax(F.col("v"))).first()
    assert abs(sum(p) - 1) < 1e-12 and k == 1
    j = spark.createDataFrame([("f", "n"), (None, "n")], "a string, b string")
    assert [r[0] for r in j.select(scalars.joined_path("d", F.col("a"), F.col("b"))).collect()] == ["d/f/n", None]


# ---- filters


def test_filter_operators(spark):
    df = spark.createDataFrame([(1, "a", [("x", 1)]), (2, "b", [("y", 2), ("x", 5)]), (3, None, []), (4, "c", None)], "id int, s string, k array<struct<f:string,n:int>>")

    def got(op, field, value=None):
        return [r.id for r in df.where(filters.compile_filter({"op": op, "content": {"field": field, "value": value}}, df.schema)).collect()]

    assert got("=", "s", "a") == [1] and got("!=", "s", "a") == [2, 3, 4] and got("in", "s", ["a", "c"]) == [1, 4] and got("exclude", "s", ["a"]) == [2, 3, 4]
    assert got("is", "s", "MISSING") == [3] and got("not", "s", "MISSING") == [1, 2, 4]
    assert got("=", "k.f", "x") == [1, 2] and got("!=", "k.f", "x") == [3, 4] and got(">", "k.n", 1) == [2] and got("is", "k.f", "MISSING") == [3, 4]
    with pytest.raises(ValueError):
        got("like", "s", "a")


def test_builder(spark):
    b = filters.FilterBuilder()
    assert b.build() == {} and b.add("a", 1).build() == {"op": "=", "content": {"field": "a", "value": 1}}
    assert b.add("b", (1, 2)).build()["op"] == "and" and b.parts[1]["op"] == "in" and b.clear().build() == {}
    assert b.add("c", 3, "in").parts[0]["content"]["value"] == [3]
    names = filters.discover_fields(schemas.CASES)
    assert "samples.portions.slides.slide_id" in names and "samples.portions" in filters.expandable_fields(schemas.CASES)


# ---- hierarchy


def slide(i):
    return {"slide_id": i, "submitter_id": f"S{i}", "percent_tumor_cells": 1.5, "percent_necrosis": None}


def cases(spark):
    case = lambda i, samples, diagnoses=None: {"case_id": i, "submitter_id": f"sub{i}", "project": {"project_id": "P1"}, "demographic": {"gender": "f"}, "diagnoses": diagnoses, "samples": samples}
    sample = lambda i, portions: {"sample_id": i, "sample_type": "tumour", "portions": portions}
    portion = lambda i, slides, aliquots=(): {"portion_id": i, "slides": slides, "analytes": [{"aliquots": [{"aliquot_id": a} for a in aliquots]}]}
    d = lambda name, flag: {"primary_diagnosis": name, "diagnosis_is_primary_disease": flag}
    data = [
        case("c1", [sample("s1", [portion("p1", [slide("x"), slide("y")], ["a1", "a2"]), portion("p2", [slide("x")], ["a3"])])], [d("first", "no"), d("second", "Yes")]),
        case("c2", [sample("s2", [portion("p3", [])])], [d("only", None)]),
        case("c3", None, []),
        case("c4", []),
    ]
    return spark.read.schema(schemas.CASES).json(spark.sparkContext.parallelize([json.dumps(x) for x in data]))


def test_flattening(spark):
    c = cases(spark)
    got = {r.slide_id: r for r in hierarchy.slides(c).collect()}
    assert set(got) == {"x", "y"} and got["x"].portion_id == "p2" and got["y"].portion_id == "p1"
    assert rows(hierarchy.sample_index(c).select("sample_id")) == [("s1",), ("s2",)]
    assert rows(hierarchy.aliquot_to_sample(c)) == [("a1", "s1"), ("a2", "s1"), ("a3", "s1")]
    assert {r.case_id: r.primary_diagnosis for r in hierarchy.case_table(c).collect()} == {"c1": "second", "c2": "only", "c3": None, "c4": None}


def file_rows(spark):
    f = lambda o, i, entity, project="P1", size=10, samples=(): {"ingest_ord": o, "file_id": i, "file_name": f"{i}.svs", "file_size": size, "associated_entities": [{"entity_id": e} for e in entity] if entity is not None else None, "cases": [{"case_id": "c", "project": {"project_id": project}, "samples": [{"sample_id": s} for s in samples]}]}
    data = [f(1, "f1", ["x", "y"]), f(2, "f2", ["y"]), f(3, "f3", ["unknown"]), f(4, "f4", None), f(5, "f5", [])]
    mafs = [f(1, "m1", [], samples=["s1"]), f(2, "m2", [], samples=["s1"])]
    read = lambda x: spark.read.schema(schemas.FILES).json(spark.sparkContext.parallelize([json.dumps(r) for r in x]))
    return read(data), read(mafs)


def test_slide_table(spark):
    data, mafs = file_rows(spark)
    got = {r.file_id: r for r in hierarchy.slide_table(data, cases(spark), mafs).collect()}
    assert set(got) == {"f1", "f2"} and got["f1"].slide_id == "x" and got["f1"].maf_file_id == "m2" and got["f1"].has_maf and got["f1"].gender == "f"


# ---- selection


def brute_round_robin(data, n):
    groups, out, d = {}, [], 0
    for o, g, s in data:
        if g is not None:
            groups.setdefault(g, []).append((o, g, s))
    while any(len(v) > d for v in groups.values()):
        out += [groups[g][d] for g in sorted(groups) if len(groups[g]) > d]
        d += 1
    return out[:n]


@pytest.mark.parametrize("seed", range(3))
def test_round_robin_and_budget(spark, seed):
    r = random.Random(seed)
    data = [(i, r.choice(["a", "b", "c", None]), r.choice([None, r.randint(1, 50)])) for i in range(60)]
    df = spark.createDataFrame(data, "o int, g string, s int")
    assert rows(selection.stratified_topn(df, "g", ["o"], 20)) == sorted(map(tuple, brute_round_robin(data, 20)), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert selection.stratified_topn(df, "g", ["o"], 0).count() == 60 == selection.stratified_topn(df, "g", ["o"], 60).count()
    assert selection.stratified_topn(df, "nope", ["o"], 5).count() == 5
    want, total = set(), 0
    for o, _, s in brute_round_robin(data, 1000):
        if total >= 300:
            break
        want.add(o)
        total += s or 0
    for block in (1, 4, 1024):
        assert {x.o for x in selection.byte_budget(df, "g", ["o"], "s", 300, block).collect()} == want
    assert selection.byte_budget(df, "g", ["o"], "s", None).count() == 60


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(1, 30)), min_size=1, max_size=25), st.integers(1, 5))
def test_lpt(spark, weights, m):
    data = [(f"k{i:02}", w) for i, w in enumerate(weights)]
    got = {r.k: r.shard for r in selection.assign_shards(spark.createDataFrame(data, "k string, w int"), "k", "w", m).collect()}
    load, want = [0] * m, {}
    for k, w in sorted(data, key=lambda x: (-(x[1] or 1), x[0])):
        s = load.index(min(load))
        want[k] = s
        load[s] += w or 1
    assert got == want and max(load) <= sum(load) / m + max(w or 1 for w in weights)


def test_strides_and_splits(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(21)], "o int, g string")
    kept = selection.stride_sample(df, "g", ["o"], 4)
    assert kept.count() == selection.stride_count(df.groupBy("g").count(), "count", 4).first()[0] == 6
    split = selection.stratified_split(df.union(spark.createDataFrame([(99, "c")], "o int, g string")), "g", F.col("o"), 0.25)
    assert {r.g: r.n for r in split.groupBy("g").agg(F.count_if("is_val").alias("n")).collect()} == {"a": 3, "b": 2, "c": 0}
    named = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test"), (4, "other")], "i int, split string")
    assert {r.i: r.is_val for r in selection.column_split(named, "split").collect()} == {1: False, 2: True, 3: True}


# ---- lookups, presence, facets


def test_merging(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "k int") for x in ([1, 2], [3]))
    assert lookups.merge_shards([a, b], "k").count() == 3
    with pytest.raises(ValueError):
        lookups.merge_shards([a, a], "k")
    with pytest.raises(ValueError):
        lookups.merge_shards([a, None], "k")


def test_presence(spark):
    events = spark.createDataFrame([("a1", "G1"), ("a1", "G1"), ("a2", None), ("a3", "G2"), ("zz", "G1"), (None, "G1")], "aliquot_id string, gene string")
    ids = spark.createDataFrame([("a1", "s1"), ("a2", "s2"), ("a3", "s1")], "aliquot_id string, sample_id string")
    long = presence.presence_long(events, ids, "aliquot_id", "sample_id", "gene")
    assert rows(long) == [("s1", "G1"), ("s1", "G2")] and presence.features_of(long, "gene") == ["G1", "G2"]
    wide = presence.presence_wide(long, ids, "sample_id", "gene", ["G1", "G9"])
    assert rows(wide) == [("s1", 1, 0), ("s2", 0, 0)]
    merged = presence.merge_presence(spark.createDataFrame([("s1", None), ("s7", None)], "sample_id string, other int"), wide, "sample_id", ["G1", "G9"])
    assert rows(merged) == [("s1", None, 1, 0), ("s7", None, 0, 0)]


def test_counts(spark):
    df = spark.createDataFrame([("a", ""), ("a", None), ("b", "x")], "p string, q string")
    assert rows(facets.facet_counts(df, ["p", "q"])) == [("p", "a", 2), ("p", "b", 1), ("q", "unknown", 2), ("q", "x", 1)]
    done = spark.createDataFrame([("d1", "f"), ("d1", "g"), ("d2", "h.partial")], "dir string, file string")
    assert facets.completed_dirs(done).first()[0] == 1


def test_task_labels(spark):
    df = spark.createDataFrame([("s1", "TCGA-LUAD", "True", "1", None, "0"), ("s2", "TCGA-GBM", "no", "1", "", ""), ("s3", "TCGA-LUSC", "yes", "7", "x", "1.0"), ("s4", None, "1", None, None, None)], "slide_id string, project_id string, has_maf string, KRAS string, IDH1 string, IDH2 string")
    by = {t.name: t for t in labels.TASKS}
    assert rows(labels.task_labels(df, by["luad_vs_lusc"], "slide_id")) == [("s1", 0), ("s3", 1)]
    assert rows(labels.task_labels(df, by["kras"], "slide_id")) == [("s1", 1)]  # 7 is no class
    assert rows(labels.task_labels(df, by["idh"], "slide_id")) == [("s1", 0), ("s3", 1)]


# ---- metrics


def brute_auroc(y, s):
    pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auroc(spark):
    r = random.Random(1)
    data = [("t", r.random() < 0.4, r.randint(0, 9)) for _ in range(200)] + [("one", True, 3), ("tie", True, 1), ("tie", False, 1)]
    df = spark.createDataFrame(data, "t string, pos boolean, s int")
    got = {x.t: x.auroc for x in metrics.auroc(df, ["t"], "s", "pos").collect()}
    want = brute_auroc([p for t, p, _ in data if t == "t"], [s for t, _, s in data if t == "t"])
    assert abs(got["t"] - want) < 1e-12 and got["one"] is None and got["tie"] == 0.5
    turned = {x.t: x.auroc for x in metrics.auroc(df.withColumn("s", -F.col("s")), ["t"], "s", "pos").collect()}
    assert abs(turned["t"] - (1 - want)) < 1e-12


def test_class_metrics(spark):
    df = spark.createDataFrame([("t", 0, 0), ("t", 0, 1), ("t", 1, 1)], "task string, y int, pred int")
    per = {r["class"]: (r.recall, r.precision) for r in metrics.class_scores(df, ["task"], 3).collect()}
    assert per == {0: (0.5, 1.0), 1: (1.0, 0.5), 2: (None, 0.0)}
    b = metrics.metric_bundle(df, ["task"], 3).first()
    assert abs(b.accuracy - 2 / 3) < 1e-12 and b.balanced_accuracy == 0.75 and abs(b.macro_f1 - 2 / 3) < 1e-12


def test_leaderboard(spark):
    df = spark.createDataFrame([("b", "t1", 0.5), ("a", "t1", 0.5), ("c", "t2", 0.9), ("d", "t9", 1.0)], "model string, task string, v double")
    out = leaderboard.ranked(leaderboard.pivot(df, "model", "task", "v", ["t1", "t2"]), "model", ["t1", "t2"])
    assert [r.model for r in out.orderBy("rank").collect()] == ["c", "a", "b", "d"]


def test_pooling_and_probe(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [7.0, 8.0]), ("c", None)], "k string, v array<float>")
    assert rows(pooling.mean_pool(df, ["k"], "v")) == [("a", [2.0, 4.0], 2), ("b", [7.0, 8.0], 1)]
    r = random.Random(0)
    e = [("m", f"i{i}", [r.gauss(3 * (i % 2), 1), r.gauss(0, 1)]) for i in range(60)]
    emb = spark.createDataFrame(e, "model string, item_id string, embedding array<double>")
    lab = [(f"i{i}", "two", i % 2) for i in range(60)] + [(f"i{i}", "few", i % 2) for i in range(4)] + [(f"i{i}", "same", 1) for i in range(20)]
    out = probe.run_grid(emb, spark.createDataFrame(lab, "item_id string, task string, label int"), rate=0.05)
    assert {x.task: x.reason for x in out.where("reason is not null").collect()} == {"few": "too few rows", "same": "one class"}
    res = probe.results(out, 2).first()
    assert res.n == 12 and res.accuracy > 0.8 and res.auroc > 0.85


# ---- imaging


def test_otsu_and_histogram(spark):
    r = np.random.default_rng(0)
    v = np.concatenate([r.normal(60, 10, 500), r.normal(180, 12, 500)]).clip(0, 255).astype(int)
    df = spark.createDataFrame([("g", int(x)) for x in v] + [("c", 200)] * 3, "g string, x int")
    hist = imaging.histogram(df, ["g"], "x")
    assert hist.count() == 512
    got = {x.g: x.threshold for x in imaging.otsu(hist, ["g"]).collect()}
    assert got["g"] == imaging.threshold_of(np.bincount(v, minlength=256)) and got["c"] == 0
    assert imaging.otsu(spark.range(4).select(F.col("id").alias("v"), F.lit(0).alias("n")), []).first()[0] == 127


def test_tiles_tars_and_decoding(spark, tmp_path):
    a = np.full((70, 130, 3), 240, np.uint8)
    a[:64, :64] = [200, 40, 40]
    images = spark.createDataFrame([("i1", 130, 70, bytearray(a.tobytes()))], "item_id string, width int, height int, content binary")
    tiles = imaging.tile(images, 0.1, 32, 2048)
    assert {(t.x, t.y) for t in tiles.collect()} == {(0, 0), (32, 0), (0, 32), (32, 32)}
    packed = imaging.pack_tars(tiles, f"file://{tmp_path}").collect()
    with tarfile.open(packed[0].path) as tar:
        assert len(packed) == 1 and packed[0].n == 4 and [m.name for m in tar] == sorted(t.path for t in tiles.collect())
    back = files.read_tars(spark, str(tmp_path))
    assert sorted((r.path, bytes(r.content)) for r in back.collect()) == sorted((t.path, bytes(t.content)) for t in tiles.collect())
    some = spark.createDataFrame([("a", bytearray(b"x" * 12)), ("b", bytearray(b"x")), ("c", bytearray(b"!"))], "path string, content binary")
    status = imaging.decode(some, lambda c: c if c != b"!" else 1 / 0, 12)
    assert {r.path: r.status for r in status.collect()} == {"a": "ok", "b": "bad_size", "c": "failed"}
    pooled = encode.item_embeddings(tiles, encode.ByteStatistics()).first()
    assert pooled.item_id == "i1" and pooled.n_patches == 4


def test_grid_and_tokens(spark):
    g = imaging.grid(spark.createDataFrame([("a", 600, 300, 1.5), ("b", 100, 900, 1.0)], "i string, width int, height int, level_downsample double"))
    assert rows(g.select("i", "gx", "gy", "x0", "y0")) == [("a", 0, 0, 0, 0), ("a", 1, 0, 384, 0)]
    assert imaging.thumbnail_scale(4000, 1000) == 3.90625 and imaging.thumbnail_scale(10, 20) == 1
    t = np.arange(12.0).reshape(6, 2)
    assert list(encode.pool_tokens(t, "first_token")) == [0, 1] and list(encode.pool_tokens(t, "first_and_mean_of_rest")) == [0, 1, 6, 7] and list(encode.pool_tokens(t, "first_and_mean_after_registers")) == [0, 1, 10, 11]


# ---- sources, plans, streams


def test_manifests(spark, tmp_path):
    (tmp_path / "m.txt").write_text("id\tfilename\tmd5\tsize\tstate\na\tf1\tm\t123.0\tok\nb\tf2\n\nc\tf3\t\tx\t\n")
    assert rows(files.read_manifest(spark, str(tmp_path / "m.txt"))) == [("a", "f1", "m", 123, "ok"), ("b", "f2", "", 0, ""), ("c", "f3", "", 0, "")]
    df = spark.createDataFrame([("b", "f", None, 5, None), ("a", "g", "m", 6, "ok")], "id string, filename string, md5 string, size long, state string")
    files.write_manifest(df, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["id\tfilename\tmd5\tsize\tstate", "a\tg\tm\t6\tok", "b\tf\t\t5\t"]


def test_binary_sources(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"aaabbbc")
    assert [(r.idx, bytes(r.content)) for r in files.read_records(spark, str(tmp_path), 3).orderBy("idx").collect()] == [(0, b"aaa"), (1, b"bbb")]
    assert files.resolve_source(spark, [("raw", f"{tmp_path}/none", "*"), ("tars", str(tmp_path), "*.tar"), ("bins", str(tmp_path), "*.bin")])[0] == "bins"
    (tmp_path / "m.maf").write_text("# note\nHugo_Symbol\tChrom\tTumor_Sample_UUID\nG1\t1\ta1\n#x\nG2\t2\ta2\n")
    assert rows(files.read_mutations(spark, str(tmp_path / "m.maf"))) == [("a1", "G1"), ("a2", "G2")]
    assert files.listing(spark, str(tmp_path), "*.bin").first().size == 7


def test_rest(spark):
    def fetch(p):
        lo = p["from"]
        return {"total": 25, "hits": [{"id": i, "name": f"n{i}"} for i in range(lo, min(25, lo + p["size"]))]}

    got = rest.read_rest(spark, rest.rest_source("toy", fetch, "id int, name string", delay=0), size=10)
    assert sorted(r.id for r in got.collect()) == list(range(25)) and got.rdd.getNumPartitions() == 3
    assert rest.read_rest(spark, rest.rest_source("toy2", fetch, "id int, name string"), 10, 12).count() == 12
    assert rest.pages(5, 20_000, None) == [(0, 5)] and rest.pages(25_000, 20_000, None)[1] == (10_000, 10_000)
    calls = []
    with pytest.raises(RuntimeError):
        rest.retried(lambda: calls.append(1) or 1 / 0, delay=0)
    assert len(calls) == 3


def test_transfer(spark):
    store = {"a": b"one", "b": b"two"}
    work = spark.createDataFrame([("a", hashlib.md5(b"one").hexdigest()), ("b", "bad"), ("c", "")], "id string, md5 string")
    assert {r.id: r.status for r in transfer.fetch_all(work, store.__getitem__, 2).collect()} == {"a": "downloaded", "b": "mismatch", "c": "failed"}
    data, asked = bytes(range(256)) * 10, []
    f = transfer.RangeFile(lambda a, b: asked.append((a, b)) or data[a:b], len(data), 1000)
    f.seek(990)
    assert f.read(20) == data[990:1010] and f.read(5) == data[1010:1015] and asked == [(0, 1000), (1000, 2000)] and f.seek(-1, 2) == 2559


def test_build(spark, tmp_path):
    data, mafs = file_rows(spark)
    mutations = spark.createDataFrame([("a1", "G1"), ("a3", "G2")], "aliquot_id string, gene string")
    config = Config.load({"projects": ["P1"]}, ["subset.max_files=1"])
    build = Build(spark, str(tmp_path), config, {"files": data, "cases": cases(spark), "mutation_files": mafs, "mutations": mutations})
    assert set(build.run().values()) == {"done"} and set(build.run().values()) == {"skipped"}
    out = build.read("assemble").collect()
    assert len(out) == 1 and (out[0].G1, out[0].G2) == (1, 1) and build.summary()["etl"][0] == 2
    config.steps = ["nope"]
    with pytest.raises(ValueError):
        build.run()
    with pytest.raises(ValueError):
        Config.load({})
    assert env_config(environ={"LAMELLAR_SIZE": "3", "X": "1"}) == {"size": "3"}


def test_build_of_images(spark, tmp_path):
    data, mafs = file_rows(spark)
    pixels = np.random.default_rng(1).integers(0, 255, (64, 96, 3), np.uint8)
    images = spark.createDataFrame([("i1", 96, 64, bytearray(pixels.tobytes()))], "item_id string, width int, height int, content binary")
    steps = ["etl", "manifest", "mutations", "acquire", "tile", "pack", "decode", "thumbnails", "summarise"]
    config = Config.load({"projects": ["P1"], "steps": steps, "tiling": {"least_tissue": 0.0, "patch": 32, "thumbnail": 32}})
    build = Build(spark, str(tmp_path), config, {"files": data, "cases": cases(spark), "mutation_files": mafs, "images": images})
    assert set(build.run(dry=True).values()) == {"to do"} and not list(tmp_path.iterdir())
    assert set(build.run().values()) == {"done"} and set(build.run(dry=True).values()) == {"skipped"}
    assert build.read("tile").count() == 6 and {r.status for r in build.read("decode").collect()} == {"ok"} and build.read("pack").first().n == 6
    small = build.read("thumbnails").first()
    assert (small.width, small.height) == (32, 21)
    assert {r.step: r.rows for r in build.read("summarise").collect()}["manifest"] == build.read("etl").count()
    level = imaging.tile(images.withColumn("level_downsample", F.lit(4.0)), 0.0, 32, 64).collect()
    assert {(t.x, t.y) for t in level} == {(x * 128, y * 128) for x in range(3) for y in range(2)}


def brute_patches(pixels, least, patch, longest):
    """Patches with tissue, cell by cell and value by value."""
    h, w = pixels.shape[:2]
    scale = max(1.0, max(w, h) / longest)
    small = np.array([[pixels[int(y * scale), int(x * scale)] for x in range(int(w / scale))] for y in range(int(h / scale))]).astype(int)
    sat, top = small.max(2) - small.min(2), small.max(2)

    def spread(v):
        a, b = sat[sat <= v], sat[sat > v]
        return a.size * b.size * (a.mean() - b.mean()) ** 2 if a.size and b.size else 0.0

    mask = (sat > max(range(256), key=spread)) & (top > 15)
    side = max(1, round(patch / scale))
    cells = {(y, x): mask[y * side : (y + 1) * side, x * side : (x + 1) * side] for y in range(h // patch) for x in range(w // patch)}
    return sorted(k for k, c in cells.items() if c.size and c.mean() >= least)


@pytest.mark.parametrize("size", [(64, 96, 40), (130, 70, 4096), (257, 300, 100), (33, 500, 77)])
def test_tissue_by_brute_force(size):
    r = np.random.default_rng(size[0])
    pixels = r.integers(200, 256, (*size[:2], 3), np.uint8)
    pixels[: size[0] // 2, size[1] // 3 :] = r.integers(0, 256, pixels[: size[0] // 2, size[1] // 3 :].shape, np.uint8)
    for least in (0.1, 0.5):
        assert sorted(map(tuple, imaging.tissue_patches(pixels, least, 16, size[2]).tolist())) == brute_patches(pixels, least, 16, size[2])


def test_decoders_and_thumbnails(spark):
    names = ["no such library", "raw"]
    imaging.DECODERS["no such library"] = lambda: __import__("no_such_library")
    assert imaging.first_decoder(names)[0] == "raw"
    with pytest.raises(RuntimeError):
        imaging.first_decoder(names[:1])
    rows = spark.createDataFrame([("a", bytearray(b"\x01" * 12)), ("b", bytearray(b"\x02" * 48)), ("c", bytearray(b"x"))], "path string, content binary")
    assert {r.path: (r.status, r.raw and len(r.raw)) for r in imaging.decode_with(rows, ["raw"], 2).collect()} == {"a": ("ok", 12), "b": ("resized", 12), "c": ("failed", None)}
    assert imaging.best_embedded({"label": (300, 200), "macro": (900, 400), "thumbnail": (1200, 1000)}, 800) == "macro"
    assert imaging.best_embedded({"label": (300, 200)}, 800) == "label" and imaging.best_embedded({}, 800) is None
    store = {"x": bytes(range(200)) * 10}
    work = spark.createDataFrame([("i", "x", 2000), ("j", "gone", 10)], "item_id string, location string, size long")
    embedded = lambda file, item: None
    level = lambda file, item: (2, 2, file.read(12))
    got = {r.item_id: r for r in imaging.remote_thumbnails(work, lambda place: lambda a, b: store[place][a:b], [embedded, level], 2).collect()}
    assert (got["i"].status, got["i"].width, len(got["i"].content)) == ("renderer 1", 2, 12) and got["j"].status == "failed" and got["j"].detail


def test_resumed_fetches_and_paths(spark, tmp_path):
    work = spark.createDataFrame([("a", ""), ("b", ""), ("c", hashlib.md5(b"c").hexdigest())], "id string, md5 string")
    calls = tmp_path / "calls"

    def fetch(i):
        with calls.open("a") as f:
            f.write(i)
        if i == "b" and calls.read_text().count("b") < 3:
            raise OSError("later")
        return i.encode()

    first = transfer.fetch_all(work.where("id <> 'c'"), fetch, 1, delay=0).collect()
    assert {r.id: r.status for r in first} == {"a": "downloaded", "b": "downloaded"}
    done = spark.createDataFrame([(r.id, r.status) for r in first], "id string, status string")
    assert {r.id: r.status for r in transfer.fetch_all(work, fetch, 1, delay=0, done=done).collect()} == {"a": "skipped", "b": "skipped", "c": "downloaded"}
    (tmp_path / "list.txt").write_text("/x/1\n\n# no\n  /x/2\n")
    assert [r.path for r in files.read_path_list(spark, str(tmp_path / "list.txt")).orderBy("place").collect()] == ["/x/1", "/x/2"]
    assert files.describe_source(spark, str(tmp_path), "*.txt").first().files == 1
    assert files.feature_file(spark, str(tmp_path), {"LAMELLAR_FEATURES": "f"}) == "f" and files.feature_file(spark, str(tmp_path), {}) is None
    (tmp_path / "m.tsv").write_text("# top\nHugo_Symbol\tOther\tTumor_Sample_UUID\nG1\tx\ta1\nG2\ty # rest\ta2\nG3#\tx\ta3\n")
    assert {(r.aliquot_id, r.gene) for r in files.read_mutations(spark, str(tmp_path / "m.tsv")).collect()} == {("a1", "G1"), (None, "G2"), (None, "G3")}


def test_plans_of_ranks_and_metrics(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("pred"))
    plan = lambda x: x._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan(selection.stratified_topn(df, "g", ["id"], 5))
    assert plan(metrics.metric_bundle(df, ["g"], 3)).partition("Physical Plan")[2].count("Range (") <= 2
    places = {r.id: r.depth for r in selection.depth(df.withColumn("x", -F.col("id")), "g", ["x", "id"]).collect()}
    assert places == {i: (999 - i) // 3 if i % 3 == 0 else (997 - i) // 3 if i % 3 == 1 else (998 - i) // 3 for i in range(1000)}
    null = df.withColumn("x", F.when(F.col("id") > 10, F.col("id")))
    assert sorted(r.depth for r in selection.depth(null, "g", ["x", "id"]).where("g = 0").collect()) == list(range(334))


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    spark.range(10).write.parquet(str(src))
    go = lambda: process_new(spark, str(src), spark.range(1).schema, str(tmp_path / "out"), str(tmp_path / "cp"), lambda s: s.withColumn("x", F.col("id") * 2))
    go()
    spark.range(10, 12).write.mode("append").parquet(str(src))
    go()
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2 * i for i in range(12)]
    e = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:30' AS ts, 'a' AS k UNION ALL SELECT timestamp_ntz'2024-01-01 00:07:00', 'a'")
    assert sorted(r.n for r in windowed_counts(e, "ts", "5 minutes", ["k"]).collect()) == [1, 1]


def test_typed_scans(spark):
    c, (f, _) = cases(spark), file_rows(spark)
    assert entities.cases(c, project_id="P1", vital_status=None).count() == 4 and entities.cases(c, case_ids=["c1", "c2"], gender="f", most=1).count() == 1
    assert entities.files(f, "P1", sort="file_size:desc", fields=["file_id"]).columns == ["file_id"] and entities.slide_images(f, "P1").count() == 0
    assert entities.flat_files(f).where("file_id = 'f1'").first().project_id == "P1"
    assert "samples.portions.slides.slide_id" in entities.catalog("cases") and entities.present(c, entities.catalog("cases", "demographic")) == ["demographic.gender", "demographic.race", "demographic.ethnicity", "demographic.year_of_birth", "demographic.year_of_death"]
    p = spark.createDataFrame([("A", ("X",)), ("B", ("Y",))], "project_id string, program struct<name:string>")
    assert [r.project_id for r in entities.projects(p, "X").collect()] == ["A"]


def test_acquisition(spark):
    work = spark.createDataFrame([("s1", "f1"), ("s2", None), ("s3", "f3"), ("s4", "f4")], "slide_id string, file_id string")
    one = lambda v, c: spark.createDataFrame([(v,)], f"{c} string")
    plan = acquire.acquisition(work, one("s1", "slide_id"), one("f3", "file_id"), "slide_id", "file_id", stream=True)
    assert {r.slide_id: r.action for r in plan.collect()} == {"s1": "skip", "s2": "fail", "s3": "reuse", "s4": "stream"}
    out = acquire.outcome(plan, spark.createDataFrame([("s3", "processed")], "slide_id string, status string"), "slide_id")
    assert {r.slide_id: r.status for r in out.collect()} == {"s1": "skipped", "s2": "failed", "s3": "processed", "s4": "missing"}


def test_single_probe_and_results(spark, tmp_path):
    r = random.Random(0)
    data = [(f"/x/p{i}.jpg", [r.gauss(4 * (i % 2), 1), r.gauss(0, 1)]) for i in range(60)]
    emb = spark.createDataFrame(data, "path string, embedding array<double>")
    lab = [(f"p{i}.jpg" if i % 3 else f"/x/p{i}.jpg", "ab"[i % 2], "val" if i % 5 == 0 else "train") for i in range(60)]
    by_column = probe.single(emb, spark.createDataFrame(lab, "path string, label string, split string"), rate=0.05)
    row = by_column.first()
    assert row.n == 12 and row.accuracy > 0.8
    assert probe.single(emb, spark.createDataFrame([x[:2] for x in lab], "path string, label string"), rate=0.05).first().n == 12
    results.write_results(by_column, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r/results_csv")).first().task == "single"
    results.write_embeddings(emb.withColumn("model", F.lit("m1")), str(tmp_path / "e"))
    results.write_embeddings(emb.withColumn("model", F.lit("m0")), str(tmp_path / "e"))
    assert [r.model for r in results.models(spark, str(tmp_path / "e")).collect()] == ["m0", "m1"]
    assert setting({"a": "auto"}, "a", 8) == 8 and setting({"a": "3"}, "a", 8) == 3 and compute_line({"batch_size": 128}) == "128 auto auto -"
