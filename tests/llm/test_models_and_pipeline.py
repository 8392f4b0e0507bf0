"""Language ID, nearest neighbours, fixity audit and the pipeline."""

import gzip
import os
import re

import numpy as np
import pytest
from helpers import by_id, docs, odd_rows
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import langid, neighbours, packing, quality, queries, substring, warc
from cairn.llm.common import table
from cairn.sources.scratch import cut_lineage, scratch_path

# language identification


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    got = queries.QUERIES["op7_language_id"](spark, sf_dir).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and 0.1 < len(held) / len(got) < 0.3
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_follows_the_checksum(spark):
    import zlib

    df = spark.range(-50, 50).select(F.col("id"), langid.held_out(F.col("id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in df.collect())


def test_training_steps_follow_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    table_, weight, bias = rng.normal(size=(40, 5)), rng.normal(size=(3, 5)), rng.normal(size=3)
    index, share = np.array([3, 7, 20, 39]), np.array([0.1, 0.4, 0.3, 0.2])

    def loss(t, w, b):
        z = w @ (share @ t[index]) + b
        return float(np.log(np.exp(z).sum()) - z[1])

    moved = [x.copy() for x in (table_, weight, bias)]
    langid.descend(*moved, (1, index, share), 1e-6)
    for at, (old, new) in enumerate(zip((table_, weight, bias), moved)):
        step = (old - new) / 1e-6 * (float(share @ share) if at == 0 else 1.0)
        slope = np.zeros_like(old)
        for k in np.ndindex(*old.shape):
            near = [x.copy() for x in (table_, weight, bias)]
            near[at][k] += 1e-6
            slope[k] = (loss(*near) - loss(table_, weight, bias)) / 1e-6
        assert np.allclose(step, slope, atol=1e-4)


def test_many_languages_and_copies(spark):
    """No bound on languages, many of them kept as embeddings; copies don't take the place of different texts."""
    rows = [(f"l{k:03}", f"{chr(97 + k % 26) * 3}{chr(97 + k // 26)} {j} " * 3 + f"w{k}x{j}") for k in range(300) for j in range(3)]
    rows += [("l000", "the same copy again and again")] * 3000 + [("l000", f"aaaa other {j}") for j in range(30)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), rows=900)
    assert len(model.languages) == 300 and model.weight is not None and model.scores.shape[1] == langid.DIMENSION
    again = langid.Model(*model.parts())
    assert again.predict("aaaa other 99") == model.predict("aaaa other 99")


def test_language_odd_rows(spark, odd_langs):
    model = langid.fit(odd_langs.select("text", "lang"))
    assert model.languages == ["aa", "bb"]
    odd = docs(spark, [*odd_rows(), (90, "123 456 !!"), (91, "é"), (92, "zzz yyy")])
    got = langid.predict(odd, model)
    of = by_id(got)
    assert got.count() == odd.count()
    assert all(of[k].lang_pred == "und" and of[k].score == 0 for k in (50, 51, 52, 90))
    assert of[91].lang_pred in ("aa", "bb") and of[92].lang_pred == "bb" and of[None].held_out is False
    nothing = langid.fit(docs(spark, []).select("text", "lang"))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(docs(spark, []), model).count() == 0


@pytest.fixture(scope="module")
def odd_langs(spark):
    rng = np.random.default_rng(0)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(40))
    rows = [(k, make("abcde" if k % 3 else "vwxyz"), "aa" if k % 3 else "bb") for k in range(300)]
    rows += [(900, None, "aa"), (901, "text", None), (902, "", "bb")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_scores_are_calibrated_and_rejected(spark, odd_langs):
    model = langid.fit(odd_langs.select("text", "lang"))
    rows = langid.predict(docs(spark, [(1, "abcab cdeab"), (2, "vwxyz zyxwv"), (3, "a v b w c x")]), model)
    of = by_id(rows)
    assert (of[1].lang_pred, of[2].lang_pred) == ("aa", "bb") and of[1].accepted and of[2].accepted
    assert of[3].score < of[1].score


def test_grams_fold_case_and_signs():
    assert (langid.grams("Ab, cD") == langid.grams("ab cd")).all()
    assert len(langid.grams("")) == 0 or (langid.grams("") >= 0).all()


# nearest neighbours


def exact(ids, vectors, asked, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in asked:
        score = np.round(unit @ unit[q], 12)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[ids[q]] = [(ids[i], score[i]) for i in order]
    return out


@pytest.mark.parametrize("table_name", ["sf0.001", "sf0.1"])
def test_recall_against_brute_force(spark, table_name):
    folder = f"/root/testdata/{table_name}"
    rows = table(spark, folder, "embeddings").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = exact(ids, vectors, np.flatnonzero(ids % 50 == 0), 5)
    got = {}
    for r in queries.QUERIES["op10_adaptive_scan"](spark, folder).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == want.keys() and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 5 * len(want)
    unit = dict(zip(ids.tolist(), vectors))
    for q, found in got.items():
        for v, s in found.values():
            a, b = unit[q], unit[v]
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


VECTORS = "vec_id bigint, embedding array<float>, label int, turned int, list string"


def test_neighbours_odd_rows(spark):
    same = [1.0, 2.0, 0.0]
    rows = [(k, same) for k in range(100, 140)] + [(0, same), (50, [0.0, 0.0, 1.0]), (51, [0.0, 0.1, 1.0])]
    rows += [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [float("nan"), 1.0, 0.0])]
    rows += [(5, [float("inf"), 1.0, 0.0]), (6, [1.0, 2.0]), (None, same), (101, same), (200, None)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], VECTORS)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 12)))
    assert sorted(got) == [0, 50, 100]
    assert [v for _, v, _ in sorted(got[0])] == [100, 101, 102, 103, 104]
    assert [v for _, v, _ in sorted(got[100])] == [0, 101, 102, 103, 104]
    assert sorted(got[50])[0][1] == 51
    assert neighbours.nearest(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, 1, ""), (1, [1.0, 1.0], 1, 1, ""), (2, [0.0, 1.0], 1, 1, "")], VECTORS)
    got = neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2]


def test_scan_keeps_the_nearest_and_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((4000, 64))
    index = neighbours.fit_index(vectors[:500], 4000, 5)
    turned, ids = index.rotate(vectors), np.arange(4000)
    missed = 0
    for q in range(20):
        rows = neighbours.scan(turned[q], q, ids, turned, 5)
        true = np.argsort(((turned - turned[q]) ** 2).sum(1))[1:6]
        missed += len(set(true) - set(rows.tolist()))
        assert q not in rows and len(rows) < 200
    assert missed <= 2
    df = spark.createDataFrame([(int(k), [float(x) for x in v[:8]], 1, 1, "") for k, v in enumerate(vectors[:600])], VECTORS)
    one = neighbours.nearest(df, F.col("vec_id") % 7 == 0).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 9)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 4)
    many = neighbours.nearest(df, F.col("vec_id") % 7 == 0).orderBy("query_id", "rank").collect()
    assert one == many


# fixity audit

PAGES = "page_id bigint, url string, html string, shard int, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES)


def page_rows():
    rows = [(k, f"http://a/{k}", f"<p>é {k}\r\n\r\n") for k in range(60)]
    return rows + [(None, None, None), (7, None, "x"), (8, "u", None), *[(9, "hot", f"v{k % 3}") for k in range(30)]]


@pytest.mark.parametrize("fanout", [2, 16])
def test_audit_finds_every_fault(spark, monkeypatch, fanout):
    monkeypatch.setattr(warc, "FANOUT", fanout)
    monkeypatch.setattr(warc, "SHARD_RECORDS", 20)
    rows = page_rows()
    hurt = [r for r in rows if r[0] != 5]
    hurt = [(i, u, "bad") if i == 11 else (i, u, h) for i, u, h in hurt] + [(1000, "new", "n"), (9, "hot", "v1")]
    got = warc.audit(warc.manifest(warc.records(pages(spark, rows))), warc.records(pages(spark, hurt))).collect()
    wrong = {(r.page_id, r.url): r.status for r in got if r.status != "intact"}
    assert wrong == {(5, "http://a/5"): "missing", (11, "http://a/11"): "damaged", (1000, "new"): "extra", (9, "hot"): "damaged"}
    for s in {r.shard for r in got} - {None}:
        mine = sorted((r.ordinal, r.offset, r.length) for r in got if r.shard == s)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert all(a[1] + a[2] == b[1] for a, b in zip(mine, mine[1:])) and mine[0][1] == 0


def test_audit_of_equal_and_empty_replicas(spark):
    made = warc.records(pages(spark, page_rows()))
    same = warc.audit(warc.manifest(made), made.repartition(3)).collect()
    assert {r.status for r in same} == {"intact"} and len(same) == 64
    none = warc.records(pages(spark, []))
    assert warc.audit(warc.manifest(none), none).count() == 0
    assert {r.status for r in warc.audit(warc.manifest(made), none).collect()} == {"missing"}
    assert {r.status for r in warc.audit(warc.manifest(none), made).collect()} == {"extra"}


def test_warc_files_round_trip(spark):
    made = warc.records(pages(spark, page_rows()))
    path = scratch_path(spark, "warc")
    warc.write_warc(made, path)
    assert warc.audit(warc.manifest(made), warc.read_warc(spark, path)).filter("status <> 'intact'").count() == 0
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect())
    assert raw.count(b"WARC/1.1\r\n") == made.count() and raw.endswith(b"\r\n\r\n")


def placed(spark, rows, order):
    """Records in the given order in one file."""
    made = {r.page_id: r for r in warc.records(pages(spark, rows)).collect()}
    out, at = [], 0
    for i in order:
        out.append((i, made[i].url, made[i].record, "f", at))
        at += len(made[i].record.encode()) + 4
    return spark.createDataFrame(out, "page_id bigint, url string, record string, file string, offset bigint")


def test_audit_of_places(spark):
    rows = [(k, f"http://a/{k}", "é" * k) for k in range(50)]
    listed = warc.manifest(warc.records(pages(spark, rows)))

    def moved(order):
        return {r.page_id for r in warc.audit(listed, placed(spark, rows, order)).collect() if r.status == "moved"}

    assert moved(range(49, -1, -1)) == set(range(1, 50))
    assert moved([*range(20), *range(21, 50), 20]) == {20, 21}
    order = [k for k in range(50) if k not in (7, 8)]
    gap = placed(spark, rows, order).withColumn("offset", F.col("offset") + F.when(F.col("page_id") > 30, 2).otherwise(0))
    wrong = {r.page_id: r.status for r in warc.audit(listed, gap).collect() if r.status != "intact"}
    assert wrong == {7: "missing", 8: "missing", 31: "moved"}


def foreign(kind, name, payload, extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n{extra}content-length:  {len(payload)}"
    return head.encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def test_files_that_others_wrote(spark, tmp_path):
    inner = foreign("metadata", "in", b"x" * 30) + foreign("metadata", "in2", b"")
    parts = [
        ("warcinfo", "a", b"software: x\r\n"),
        ("response", "b", b"HTTP/1.1 200 OK\r\n\r\n<p>\xff\xfe\x00 raw"),
        ("conversion", "c", b"see " + inner + inner + b"end"),
        ("resource", "d", b""),
        ("resource", "e", b"\r\n\r\n\r\nWARC/1.1 is a mark" * 3),
        ("resource", "f", inner),
    ]
    whole = b"".join(foreign(*p, "WARC-Target-URI: http://t\r\n") for p in parts)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "one.warc").write_bytes(whole)
    (tmp_path / "plain" / "empty.warc").write_bytes(b"")
    (tmp_path / "gz").mkdir()
    members = [gzip.compress(foreign(*p, "WARC-Target-URI: http://t\r\n")) for p in parts]
    (tmp_path / "gz" / "one.warc.gz").write_bytes(b"".join(members))
    at = [whole.index(foreign(*p, "WARC-Target-URI: http://t\r\n")) for p in parts]
    for folder in ("plain", "gz"):
        df = warc.read_warc(spark, str(tmp_path / folder)).withColumn("record", F.col("record").cast("binary"))
        rows = df.orderBy("offset").collect()
        assert [(r.type, r.record_id, bytes(r.record).split(b"\r\n\r\n", 1)[1]) for r in rows] == [
            (k, f"<urn:uuid:{n}>", b) for k, n, b in parts
        ]
        assert [r.offset for r in rows] == at and all(r.whole and r.url == "http://t" and r.page_id is None for r in rows)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        split = warc.read_warc(spark, str(tmp_path / "plain"))
        assert [(r.record_id, r.offset) for r in split.orderBy("offset").collect()] == [(f"<urn:uuid:{p[1]}>", o) for p, o in zip(parts, at)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_hurt_files(spark, tmp_path):
    parts = [foreign("resource", str(k), b"payload %d" % k) for k in range(6)]
    hurt = [p for p in parts]
    hurt[1] = hurt[1].replace(b"content-length:  9", b"content-length:  99999")
    hurt[2] = hurt[2].replace(b"content-length", b"content-lexgth")
    hurt[5] = hurt[5][:-8]
    (tmp_path / "a.warc").write_bytes(b"junk before\r\n\r\n" + b"".join(hurt))
    (tmp_path / "b.txt").write_bytes(b"no record at all")
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.record_id[10:-1], r.whole) for r in rows] == [("0", True), ("1", False), ("3", True), ("4", True), ("5", False)]
    assert rows[0].record.endswith("payload 0") and rows[4].record.endswith("paylo")


# queries and pipeline


def test_every_operator_has_one_query():
    numbers = [int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11))


def test_bucket_query_covers_all(spark, sf_dir):
    got = queries.QUERIES["op2_length_buckets"](spark, sf_dir)
    assert got.count() == table(spark, sf_dir, "documents").count()


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    frames = [table(spark, sf_dir, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(cut_lineage(stage(spark, frames[-1], sf_dir)))
    return frames


def test_stage_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(f.columns == stages[0].columns and f.dtypes == stages[0].dtypes for f in stages[:5])


def test_quality_stage(stages):
    good = {r.doc_id for r in quality.quality_report(stages[0]).filter("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == good


def shingles(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_dedup_stage(stages):
    """Against all pairs: what went has a near copy, no exact copies stay, ids are the smallest."""
    before = {r.doc_id: shingles(r.text) for r in stages[1].collect()}
    after = {r.doc_id for r in stages[2].collect()}
    parent = {i: i for i in before}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(before)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(before[a] & before[b])
            if both >= 0.8 * (len(before[a]) + len(before[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    want = {i for i in ids if find(i) == i}
    assert after == want
    texts = [r.text for r in stages[2].collect()]
    assert len(texts) == len(set(texts))


def test_substring_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = substring.brute_force(rows)
    import hashlib

    got = {r.doc_id: hashlib.sha256(" ".join((r.text or "").split()).encode()).hexdigest() for r in stages[3].collect()}
    plain = {i: hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for i, t in rows}
    assert got == {i: want[i][2] if want[i][1] else plain[i] for i in want}
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_secret_stage(stages):
    from cairn.llm import credentials

    ranks = credentials._ranks((*credentials.COMMON, *credentials.learn_words(stages[3])))
    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys()
    for i, r in before.items():
        found = credentials.scan(r.text, ranks)
        assert after[i].text == (credentials.redact_text(r.text, found, "[SECRET]") if found else r.text)


def test_packing_stage(stages):
    want = {r.doc_id: r.n_tokens for r in packing.word_lengths(stages[4]).collect()}
    assert {r.doc_id: r.n_tokens for r in stages[5].collect()} == want


def test_run_equals_the_stages(spark, sf_dir, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, stages[5].collect()))


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, None, None, None) for i, t in odd_rows()]
    for some in (rows, []):
        frame = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            frame = cut_lineage(stage(spark, frame, sf_dir))
        assert (frame.count() > 0) == bool(some)


def test_workers_need_no_installed_package(tmp_path):
    """Functions travel with their tasks: executors start elsewhere and only the driver knows the path."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from cairn.session import local_session\nfrom cairn.llm import queries\n"
        "s = local_session(2)\nprint('rows', queries.QUERIES['op8_secret_scan'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
