"""The registered queries: those with SQL against DuckDB, the pipeline's stages on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecspark.llm import queries
from vecspark.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rows = queries.QUERIES[name](spark, sf_dir)
    names = sorted(rows.columns)
    want = c.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, rows.select(*names).collect()))) == sorted(map(repr, want))


def test_every_operator_is_registered():
    numbers = [int(n.split("_")[0][2:]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11))


def test_pipeline_stages(spark, sf_dir):
    odd = [(None, "null id with words enough to be kept here", "en", "s", 5), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "1234 5678", "en", "s", 9)]
    odd += [(9004, "the very same words are in two rows of this table", "en", "s", 5)] * 2
    docs = table(spark, sf_dir, "documents")
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        counts.append(out.count())
        if name != "packing":
            assert out.columns == columns
            assert out.select("doc_id").where("doc_id < 9000").distinct().count() <= docs.count()
        docs = out
    assert counts[1] == counts[0] - 3  # no text, an empty one, and digits only
    assert counts[2] <= counts[1] and counts[3] <= counts[2] and counts[4] <= counts[3] and counts[5] > 0
    assert docs.where("doc_id = 9004").select("doc_id").distinct().count() == 1


def test_pipeline_decides_rows_without_ids_for_themselves(spark, tmp_path):
    name = lambda n, k: " ".join(f"{n}word{i}" for i in range(k))
    spark.createDataFrame([(1, name("bench", 13))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, name("a", 60)), (None, name("a", 60)), (None, name("b", 60)), (None, name("b", 59) + " c"), (None, name("bench", 13)), (None, "clean words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    texts = [r.text for r in left.collect()]
    assert len(texts) == 4 and texts.count(name("a", 60)) == 1 and (name("b", 60) in texts) != (name("b", 59) + " c" in texts)
    assert {r.text for r in left.where("text = 'clean words only'").collect()} == {"clean words only"}
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted(r.text for r in clean.collect()) == sorted(t for _, t in rows if "bench" not in t)


CLASHING = ["id", "h", "t", "line", "norm", "key", "__key", "__id", "__dropped", "dropped_lines", "n_lines", "__lang_pred", "__score", "kept", "spans", "start", "held_out", "rep", "cls"]


def test_pipeline_on_odd_tables(spark, sf_dir, tmp_path):
    """Empty tables, one very long text, and columns that are named like the stages' own."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    few = table(spark, sf_dir, "documents").where("doc_id < 40")
    long = " ".join(f"word{i % 5000}" for i in range(120_000)) + "\nlast line"
    docs = few.unionByName(spark.createDataFrame([(9000, long, "en", "s", len(long)), (9001, None, "en", "s", 0)], few.schema))
    docs = docs.select("*", *(F.lit(f"{c} stays").alias(c) for c in CLASHING)).cache()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, str(tmp_path)).cache(), stage(spark, empty, str(tmp_path))
        assert none.count() == 0
        if name != "packing":
            assert out.columns == docs.columns == none.columns
            assert all(r[c] == f"{c} stays" for r in out.select(*CLASHING).distinct().collect() for c in CLASHING)
            kept = out.where("doc_id = 9000").first()
            assert kept.text == long and kept.n_chars == len(long)
            docs = out
    pieces = out.where("doc_id = 9000").orderBy("start").collect()
    assert pieces[0].start == 0 and sum(r.length for r in pieces) == pieces[0].doc_tokens == sum(len(r.ids) for r in pieces)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """A small corpus whose right result is plain: each stage has something to take away."""
    name = lambda n, k: " ".join(f"{n}word{i}" for i in range(k))
    spark.createDataFrame([(1, name("bench", 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    footer = "this footer stands below every single page of the site"
    rows = [
        (1, f"{name('a', 40)}\n{footer}", f"{name('a', 40)}\n{footer}"),
        (2, f"{name('b', 40)}\n{footer}", name("b", 40)),
        (3, f"{name('c', 30)}\n{footer.replace('single', 'singel')}", name("c", 30)),
        (4, "12 34 ½", None),  # no language
        (5, footer, None),  # nothing but a repeated line
        (6, f"x {name('d', 60)}\ny {name('e', 60)}", f"x {name('d', 60)}\ny {name('e', 60)}"),
        (7, f"y {name('e', 30)} {name('f', 30)}", f"y {name('e', 30)} {name('f', 30)}"),  # half of a line is no copy
        (8, f"{name('g', 10)} {name('bench', 20)}", None),  # contaminated
        (9, f"{name('g', 90)} {name('k', 90)} {name('m', 90)} bench", f"{name('g', 90)} {name('k', 90)} {name('m', 90)} bench"),
        (10, None, None),
    ]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from vecspark.llm.tokens import byte_bpe_encoder

    encode, got = byte_bpe_encoder(), {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "start").collect():
        assert r.start == len(got.get(r.doc_id, [])) and r.length == len(r.ids)
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: [*encode(t).tolist(), 0] for i, _, t in rows if t is not None}
