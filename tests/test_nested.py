"""Small literal fixtures for nested data, search, files and tables."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import nested as N
from quire.functions import predicates as P
from quire.operators import nested as O
from quire.runtime import scratch_path
from quire.sources import readers, sinks


def test_people_table_round_trip(spark):
    people = spark.createDataFrame([(1, "Alice", 29), (2, "Bob", 35), (3, "Charlie", 23)], "id long, name string, age long")
    out = sinks.write_table(people, "quire_people", scratch_path(spark, "people"))
    assert out.count() == 3
    sinks.catalog_ops(spark, "drop", "quire_people")
    assert not sinks.catalog_ops(spark, "exists", "quire_people")


def test_only_presentation_urls_are_kept(spark):
    rows = [("test_id_1", [("i1", [("https://x.org/presentation/manifest1",)])]), ("test_id_2", [("i2", [("https://x.org/presentation/manifest2",)])]),
            ("test_id_3", [("i3", [("https://othersite.com/not_a_manifest",)])])]
    works = spark.createDataFrame(rows, "id string, items array<struct<id:string,locations:array<struct<url:string>>>>")
    locations = O.explode_multi_level(works, ["items", "locations"], ["id"])
    urls = [r.u for r in locations.where(F.col("_2.url").contains("/presentation/")).select(F.col("_2.url").alias("u")).collect()]
    assert sorted(u.rsplit("/", 1)[1] for u in urls) == ["manifest1", "manifest2"]


def test_failed_download_is_a_two_byte_file(spark):
    df = spark.createDataFrame([("{}",), ('{"id": 1}',)], "body string")
    assert sinks.failed_download_audit(df, "body").first().asDict() == {"n_total": 2, "n_failed": 1, "pct_failed": 50.0}


LABELS = [(1, "Children and criminal law", "subject"), (2, "Criminal law", "subject"), (3, "Police meeting", "Meeting"),
          (4, "Youth services", "subject"), (5, "Legal consultation", "Meeting")]


@pytest.mark.parametrize("query,want", [
    ("children AND criminal", [1]), ("criminal OR police", [1, 2, 3]), ("meeting", [3, 5]), ("children AND law", [1]),
    ("legal OR youth", [4, 5]), ("nonexistent", []), ("police or children and LAW", [1, 3]), ("AND", []), ("", []), ("AND police", [])])
def test_boolean_search(spark, query, want):
    df = spark.createDataFrame(LABELS, "idx long, label string, type string")
    assert [r.idx for r in P.boolean_query_search(df, query).collect()] == want


def test_search_reports_fields_and_terms(spark):
    df = spark.createDataFrame(LABELS, "idx long, label string, type string")
    hit = P.boolean_query_search(df, "meeting AND police").first()
    assert hit.match_fields == ["label", "type"] and hit.matched_terms == ["meeting", "police"]


def test_flattening_edge_cases(spark):
    schema = """id string, title string, description string, physicalDescription string, lettering string, referenceNumber string, edition string,
      contributors array<struct<agent:struct<label:string>,primary:boolean,roles:array<struct<label:string>>>>, alternativeTitles array<string>,
      subjects array<struct<label:string>>, genres array<struct<label:string>>, languages array<struct<id:string,label:string>>,
      production array<struct<label:string>>, notes array<struct<contents:array<string>>>, workType struct<id:string,label:string>,
      availabilities array<struct<label:string>>"""
    row = ("w1", "T", None, None, None, None, None, [(("Ann",), True, []), ((None,), False, [("author",)]), (("Bob",), False, [("editor",)])],
           None, [("s1",), ("s2",)], [], None, None, [(["a", "b"],), (["c"],)], None, None)
    out = O.works_text_flattened(spark.createDataFrame([row], schema)).first()
    assert out.contributor_names == "Ann (contributor); Bob (editor)"
    assert out.note_contents == "a b; c" and out.subject_labels == "s1; s2"
    assert out.alternative_titles == "" and out.work_type == "" and out.description is None


def test_large_parents_are_split_but_whole(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(1).alias("k"), F.col("id").alias("v"))
    out = O.nest_children(df, ["k"], ["v"], ["v"], max_items=200).collect()
    assert len([r for r in out if r.k == 0]) > 1 and len([r for r in out if r.k == 1]) == 1
    assert sorted(c.v for r in out if r.k == 0 for c in r.children) == list(range(900))


def test_pages_are_contiguous_and_bounded(spark):
    df = spark.range(1000).select(F.lit(None).cast("string").alias("k"), F.lit("same").alias("v")).unionByName(
        spark.range(250).select(F.lit("b").alias("k"), F.lpad(F.col("id").cast("string"), 3, "0").alias("v")))
    out = O.nest_children(df, ["k"], ["v"], ["v"], max_items=100).collect()
    assert sorted((r.part_no, len(r.children)) for r in out if r.k is None) == [(i, 100) for i in range(10)]
    pages = sorted((r.part_no, [c.v for c in r.children]) for r in out if r.k == "b")
    assert [p for p, _ in pages] == [0, 1, 2] and [v for _, c in pages for v in c] == [f"{i:03d}" for i in range(250)]


def test_small_fractions_are_not_cut(spark):
    from quire.operators.sampling import hash_sample, z_score
    df = spark.range(200_000)
    assert 2 <= hash_sample(df, "id", 0.00005).count() <= 25 and 35 <= hash_sample(df, "id", 0.0003).count() <= 90
    assert (z_score(0.95), z_score(0.85), z_score(0.999)) == (1.959964, 1.439531, 3.290527)


def test_tokens_are_split_once(spark):
    from quire.operators import text as T
    df = spark.createDataFrame([("a b c",)], "t string")
    for grams in (T.ngrams(T.regex_tokenize(df, "t", 1), "tokens", 2), T.ngrams(T.regex_tokenize(df, "t", 1), "tokens", 3)):
        assert grams._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
        assert grams.count() in (1, 2)


def test_first_element_of_an_empty_array(spark):
    df = spark.createDataFrame([([],), ([("x",)],), (None,)], "a array<struct<f:string>>")
    assert [r[0] for r in df.select(N.first_element("a", "f")).collect()] == [None, "x", None]


def test_child_paths_and_profile(spark):
    df = spark.createDataFrame([("1", [("a", [1, 2]), ("b", None)]), ("2", None)], "id string, kids array<struct<n:string,xs:array<int>>>")
    assert O.child_paths(df.schema) == ["kids", "kids.xs"]
    rows = {r.path: r for r in O.schema_profile(df).collect()}
    assert rows["kids.n"].non_null == 2 and rows["kids.xs"].max_size == 2 and rows["kids"].non_null == 1
    assert sorted(r.xs for r in O.child_table(df, "kids.xs").collect()) == [1, 2]


def test_json_inference_sees_rare_fields(spark):
    df = spark.range(500).select(F.when(F.col("id") == 499, '{"a": 1, "rare": "x"}').otherwise('{"a": 1}').alias("j"))
    out = readers.json_infer_parse(df, "j", "p")
    assert out.where("p.rare = 'x'").count() == 1


def test_json_docs_have_their_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"w{i}_m{i}.json").write_text(json.dumps({"id": i, "xs": [1, 2]}, indent=1))
    docs = readers.read_json_docs(spark, str(tmp_path))
    keyed = readers.key_from_filename(docs, "source_file").select("id", "manifest_id").collect()
    assert sorted((r.id, r.manifest_id) for r in keyed) == [(f"w{i}", f"m{i}") for i in range(3)]


def test_checkpointed_slices_resume(spark):
    df = spark.range(30).select(F.col("id"), (F.col("id") % 3).alias("s"))
    out, seen = scratch_path(spark, "slices"), []

    def work(part):
        seen.append(part.select("s").first()[0])
        if len(seen) == 2:
            raise RuntimeError("stopped")
        return part.withColumn("y", F.col("id") * 2)

    with pytest.raises(RuntimeError):
        sinks.partition_checkpoints(df, work, out, "s")
    result = sinks.partition_checkpoints(df, work, out, "s")
    assert seen == [0, 1, 1, 2] and result.count() == 30


def test_slices_may_be_null_or_hold_slashes(spark):
    df = spark.createDataFrame([(1, "a/b"), (2, None), (3, None), (4, "c d")], "id long, s string")
    out = scratch_path(spark, "slices")
    for _ in range(2):
        got = sinks.partition_checkpoints(df, lambda part: part, out, "s").select("id", "s").collect()
        assert sorted(map(tuple, got)) == [(1, "a/b"), (2, None), (3, None), (4, "c d")]


def test_index_sink_may_run_again(spark):
    path = scratch_path(spark, "index")
    df = spark.createDataFrame([(1, 0, "x", [1.0]), (2, 0, "y", [2.0])], "id long, chunk_index int, chunk_text string, embedding array<float>")
    for _ in range(2):
        assert sorted(r[0] for r in sinks.index_partition_sink(df, path).collect()) == ["1_0", "2_0"]
    assert [r[0] for r in sinks.index_partition_sink(df.where("id = 2"), path, run="1").collect()] == ["2_0"]
    assert spark.read.parquet(path).count() == 3


def test_counting_stream_may_run_again(spark):
    from quire.streaming import ingest
    source, out, checkpoint = (scratch_path(spark, x) for x in ("source", "counts", "checkpoint"))
    first = scratch_path(spark, "first")

    def run():
        counts = ingest.stream_label_counts(ingest.open_stream(spark, source, spark.range(1).schema, 1), "id")
        wins = ingest.stream_first_wins(ingest.open_stream(spark, source, spark.range(1).schema, 1), ["id"], ["id"], first, f"{checkpoint}-first")
        return ingest.run_counts(counts, out, checkpoint).agg(F.sum("n")).first()[0], wins.count()

    for k in range(3):
        spark.range(10).coalesce(1).write.mode("append").parquet(source)
    assert run() == (30, 10)
    assert run() == (30, 10)
    spark.range(5, 15).coalesce(1).write.mode("append").parquet(source)
    assert run() == (40, 15)
