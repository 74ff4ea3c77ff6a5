import hashlib
import random
import zlib

import oracle
import pytest
from llm_fixtures import *  # noqa: F403
from llm_fixtures import DOCUMENTS, SF_DIR
from pyspark.sql import functions as F

from perexpo.llm import merkle
from perexpo.llm.queries import ORACLE_SQL, QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, arity):
    """Root, and the siblings of every leaf as (left, right) level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place - place % arity
            run = level[first : first + arity]
            paths[i].append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        at = [place // arity for place in at]
    return level[0], paths


def plain_manifest(rows, arity=16):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows in the order of the documents' columns."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None else None
        cut = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        leaf, other = (plain_leaf((doc_id, source, lang, n_chars, t)) for t in (text, changed))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, other if cut else leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: r[:3])
        trees[s] = plain_tree([r[2] for r in groups[s]], arity)
    root, crown = plain_tree([trees[s][0] for s in names], arity)
    out = []
    for s, above in zip(names, crown, strict=True):
        for (_, _, leaf, doc_id, used), path in zip(groups[s], trees[s][1], strict=True):
            for left, right in (steps := path + above):
                used = sha(left + used + right)
            out.append((doc_id, leaf, trees[s][0], root, sha("".join(a + b for a, b in steps)), used))
    return out


def found_rows(spark, df, arity=16):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(merkle.document_leaves(df, tampered), "source", ["doc_id"], arity)
    path = F.col("path")
    out = found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(path), merkle.fold(F.coalesce("other_leaf", "leaf"), path)
    )
    return [tuple(r) for r in out.collect()]


def made_rows(sizes):
    rng = random.Random(1)
    rows = []
    for source, n in sizes:
        for _ in range(n):
            doc_id = rng.choice([None, rng.randint(0, 10**6), 7])
            text = rng.choice([None, "", "AbC é Ünd \n", "x" * rng.randint(0, 50), f"Doc {doc_id}"])
            rows.append((doc_id, text, rng.choice([None, "de", ""]), source, rng.choice([None, 3])))
    return rows


@pytest.mark.parametrize("arity", [2, 16])
def test_manifest_equals_a_plain_tree(spark, arity):
    rows = made_rows([(None, 1), ("", 2), ("a", 16), ("b", 17), ("Z", 257), ("é", 33), ("-", 1), ("=", 15)])
    rows += rows[:40]  # repeated rows
    random.Random(2).shuffle(rows)
    found = found_rows(spark, spark.createDataFrame(rows, DOCUMENTS).repartition(5), arity)
    assert sorted(found, key=str) == sorted(plain_manifest(rows, arity), key=str)


def test_more_groups_than_one_run(spark):
    rows = made_rows([(f"s{i:03d}", 1 + i % 3) for i in range(40)])
    assert sorted(found_rows(spark, spark.createDataFrame(rows, DOCUMENTS)), key=str) == sorted(plain_manifest(rows), key=str)


def test_one_row_and_no_row(spark):
    rows = [(1, "A", None, None, 1)]
    assert found_rows(spark, spark.createDataFrame(rows, DOCUMENTS)) == plain_manifest(rows)
    assert found_rows(spark, spark.createDataFrame([], DOCUMENTS)) == []


def test_a_changed_text_is_found(spark):
    df = spark.createDataFrame([(i, "Some Text", "en", "s", 9) for i in range(40)], DOCUMENTS)
    found = merkle.manifest(merkle.document_leaves(df, F.col("doc_id") == 3), "source", ["doc_id"])
    ok = merkle.fold(F.coalesce("other_leaf", "leaf"), F.col("path")) == F.col("root")
    assert [r.doc_id for r in found.where(~ok).collect()] == [3]


def test_extra_columns_and_clashing_names(spark):
    more = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(20)], DOCUMENTS)
    for name in ("tree", "place", "n", "digest", "children", "row", "up", "root", "leaf"):
        more = more.withColumn(name, F.lit("x"))
    rows = merkle.manifest(merkle.document_leaves(more).withColumn("n", F.lit(5)).withColumn("tree", F.lit("t")), "source", ["doc_id"])
    assert set(rows.columns) == {"doc_id", "source", "leaf", "n", "tree", "subroot", "root", "path"}
    assert {(r.n, r.tree) for r in rows.collect()} == {(5, "t")}


def test_siblings_of_a_slot(spark):
    row = spark.range(1).select(merkle.siblings(F.lit(5).cast("bigint"), 2).alias("two"), merkle.siblings(F.lit(5).cast("bigint"), 4).alias("four"))
    assert row.first() == ([4], [4, 6, 7])


def test_query_equals_sql(spark):
    assert oracle.spark_rows(QUERIES["op13_merkle"](spark, SF_DIR)) == oracle.duck_rows(
        oracle.connect(SF_DIR), ORACLE_SQL["op13_merkle"]
    )
