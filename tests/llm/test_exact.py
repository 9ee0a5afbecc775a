import hashlib
import random

import pytest

from quadloom.llm import exact


def test_against_brute_force(documents):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", "A", "", None, f"t{i % 40}"])) for i in range(200)]
    got = {g.doc_id: g for g in exact.exact_dedup(documents(rows)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t in rows:
        g, same = got[i], groups[t or ""]
        assert (g.keep_id, g.group_size, g.kept) == (max(same), len(same), i == max(same))
        assert bytes(g.digest) == hashlib.sha256((t or "").encode()).digest()


def test_index_persists_and_grows(spark, documents, tmp_path):
    path = str(tmp_path / "index")
    first = exact.exact_dedup(documents([(1, "a"), (2, "a"), (3, "b")]), path, "monday").collect()
    assert {(g.doc_id, g.kept) for g in first} == {(1, False), (2, True), (3, True)}
    second = documents([(10, "a"), (11, "c"), (12, "c")])
    for _ in range(2):  # a batch that runs again is not added twice
        got = {(g.doc_id, g.keep_id, g.kept) for g in exact.exact_dedup(second, path, "tuesday").collect()}
        assert got == {(10, 2, False), (11, 12, False), (12, 12, True)}
    index = exact.DigestIndex(spark, path)
    rows = index.table().collect()
    assert len(rows) == 3 and {(x.keep_id, x.batch) for x in rows} == {(2, "monday"), (3, "monday"), (12, "tuesday")}
    plan = index.table().join(index.table().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # bucketed by digest on both sides
    index.close()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def side(plan, scan):
    """The plan's lines from the last join or aggregate above a scan down to it."""
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if scan in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    out, level = [], depth(lines[at])
    for x in lines[at::-1]:
        if depth(x) <= level:
            if "Join" in x:
                break
            out.append(x)
            level = depth(x)
    return out


def test_reopened_with_another_number_of_buckets(spark, documents, tmp_path):
    path = str(tmp_path / "index")
    rows = [(i, f"text {i}") for i in range(200)]
    exact.exact_dedup(documents(rows), path, "a", buckets=8).count()
    got = exact.exact_dedup(documents([(1000 + i, t) for i, t in rows]), path, "b", buckets=4).collect()
    assert len(got) == 200 and not any(g.kept for g in got) and {(g.doc_id - 1000, g.keep_id) for g in got} == {(i, i) for i, _ in rows}
    index = exact.DigestIndex(spark, path, 3)
    assert index.buckets == 8 and index.table().count() == 200
    # neither the anti-join nor the look-up of owners shuffles the index
    digests = exact.digests_of(documents(rows[:5]))
    plan = plan_of(index.owners(digests))
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert not any("Exchange" in x for x in side(plan, "Bucketed: true"))
    index.close()


def test_a_batch_that_was_half_written_is_written_anew(spark, documents, tmp_path):
    path = str(tmp_path / "index")
    rows = documents([(i, f"text {i}") for i in range(100)])
    exact.exact_dedup(documents([(500, "text 7")]), path, "before").count()
    # an application that dies in its append leaves some files and no marker
    index = exact.DigestIndex(spark, path)
    index.add(exact.digests_of(rows.filter("doc_id < 40")), "batch/1 é")
    (tmp_path / "index" / "batches" / index._marker("batch/1 é").rsplit("/", 1)[-1]).unlink()
    assert not index.has("batch/1 é")
    index.close()
    for _ in range(2):
        got = exact.exact_dedup(rows, path, "batch/1 é").collect()
        assert len(got) == 100 and [g.doc_id for g in got if not g.kept] == [7]
    index = exact.DigestIndex(spark, path)
    assert index.table().count() == 100
    index.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_another_folder_is_refused(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "some.txt").write_text("data")
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, str(tmp_path / "x"))
    exact.DigestIndex(spark, str(tmp_path / "y")).close()
    (tmp_path / "y" / "index.json").write_text('{"schema": "other", "buckets": 4}')
    (tmp_path / "y" / ".index.json.crc").unlink()
    with pytest.raises(ValueError):
        exact.DigestIndex(spark, str(tmp_path / "y"))


def test_odd_rows(odd, clashing, empty):
    got = exact.exact_dedup(odd).collect()
    assert len(got) == 11 and sum(g.kept for g in got) == 7
    assert sorted(g.doc_id for g in got if g.kept and g.doc_id) == [2, 3, 5, 6, 7, 8]
    assert exact.exact_dedup(empty).count() == 0 and exact.exact_dedup(clashing).count() == 11
    kept = exact.keep_one(odd)
    assert kept.count() == 7 and kept.columns == odd.columns


def test_normalized(documents):
    from pyspark.sql import functions as F

    got = exact.exact_dedup(documents([(1, "A b"), (2, "a  B")]), normalize=lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))
    assert {(g.doc_id, g.keep_id) for g in got.collect()} == {(1, 2), (2, 2)}
