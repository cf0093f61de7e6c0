import bz2
import json
import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from siftwell import ingestion_report, load_table, write_cleaning, write_quarantine
from siftwell import apply_cleaning, propose_cleaning
from siftwell.sources import delimited, documents, readers
from siftwell.sources.readers import detect_format, nan_to_null, tidy_names
from verification.queries import _write_document, _write_packed_document


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True, parents=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(target)

    return write


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ragged_rows(spark, put):
    loaded = load_table(spark, put("ragged.csv", 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n6,7,8,\n"x,1",2,3\n'))
    assert rows(loaded.data) == [("1", 2, 3), ("4", 5, None), ("x,1", 2, 3)]
    assert rows(loaded.quarantined) == [("6,7,8,",), ("6,7,8,9",)]
    assert loaded.notes == ("2 row(s) had a mismatched column count and were quarantined (excluded) during load.",)
    assert loaded.data.count() == 3 and loaded.data.select("b").count() == 3 and loaded.quarantined.count() == 2


def test_records_over_several_lines(spark, put):
    loaded = load_table(spark, put("lines.csv", 'a,b\n"one\ntwo",1\n3,4,5\n'), multi_line=True)
    assert rows(loaded.data) == [("one\ntwo", 1)]
    assert loaded.quarantined.count() == 1


def test_headers(spark, put):
    loaded = load_table(spark, put("headers.csv", " a ,a,,b\n1,2,3,4\n"))
    assert loaded.data.columns == ["a", "a_1", "unnamed_2", "b"]
    assert any("1 unnamed column(s)" in n for n in loaded.notes) and any("whitespace trimmed" in n for n in loaded.notes)
    assert tidy_names(["A", "a", None]) == (["A", "a_1", "unnamed_2"], tidy_names(["x", "y", None])[1])


def test_missing_tokens(spark, put):
    loaded = load_table(spark, put("nulls.tsv", "v\tw\nNA\t1\nnull\t2\nN/A\t3\nNone\t4\n#N/A\t5\nnan\t6\n-\t7\n\t8\n"))
    assert loaded.source_type == "tsv"
    assert loaded.data.where("v IS NULL").count() == 7
    assert rows(loaded.data.where("v IS NOT NULL")) == [("-", 7)]


def test_types_of_delimited_columns(spark, put):
    text = "i,f,b,t,m,e\n1,1.5,True,x,1,\n-2,2,false,y,z,\n3,,True,,1.0,\n"
    loaded = load_table(spark, put("types.csv", text))
    assert dict(loaded.data.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "t": "string", "m": "string", "e": "string"}
    assert set(dict(load_table(spark, put("types.csv", text), typed=False).data.dtypes).values()) == {"string"}


def test_other_encodings(spark, put):
    loaded = load_table(spark, put("latin1.csv", "n,v\ncafé,1\n".encode("latin-1")))
    assert rows(loaded.data) == [("café", 1)]
    assert loaded.notes == ("File was not valid UTF-8; decoded using 'latin-1' fallback.",)
    put("mixed/a.csv", "n,v\ncafé,1\n".encode("latin-1"))
    folder = put("mixed/b.csv", "n,v\nthé,2\n".encode()).rsplit("/", 1)[0]
    assert rows(load_table(spark, folder, "csv").data) == [("café", 1), ("thé", 2)]
    assert rows(load_table(spark, put("bom.csv", b"\xef\xbb\xbfn,v\nx,1\n")).data.select("n", "v")) == [("x", 1)]


def test_json_envelope(spark, put):
    loaded = load_table(spark, put("envelope.json", '{"data":[{"a":{"b":1},"e":[1]},{"a":{"b":2}}],"meta":1}'))
    assert loaded.data.columns == ["a.b", "e"] and loaded.data.count() == 2
    assert loaded.notes == ("Top-level JSON was an object; used the 'data' list field.",)


def test_json_object_and_list(spark, put):
    single = load_table(spark, put("object.json", '{"a":1}'))
    assert rows(single.data) == [(1,)] and "wrapped" in single.notes[0]
    several = load_table(spark, put("list.json", ' [{"a":1,"data":[1]},{"a":2}]'))
    assert several.data.count() == 2 and several.notes == ()
    with pytest.raises(ValueError):
        load_table(spark, put("scalars.json", '{"rows":[1,2]}'))


def test_formats(spark, put):
    assert [detect_format(p) for p in ("a.csv", "b.TSV", "c.json", "d.parquet", "e", "f.txt")] == ["csv", "tsv", "json", "parquet", "csv", "csv"]
    with pytest.raises(ValueError):
        detect_format("book.xlsx")
    with pytest.raises(ValueError):
        load_table(spark, put("a.csv", "a\n1\n"), "orc")
    with pytest.raises(ValueError):
        load_table(spark, put("empty.csv", ""))


def test_report_of_a_load(spark, put):
    report = ingestion_report(load_table(spark, put("blank.csv", "a,b\n1,\n2,\n")))
    assert [r["issue"] for r in report.issues.collect()] == ["Column(s) entirely empty: ['b']"]
    summary = report.summary.first()
    assert (summary["source_type"], summary["file_name"], summary["row_count"], summary["column_count"]) == ("csv", "blank.csv", 2, 2)
    assert sorted(r["row"] for r in report.sample_rows.collect()) == ['{"a":1}', '{"a":2}']
    assert load_table(spark, put("none.csv", "a,b\n")).notes == ("Loaded dataframe has zero rows.",)


def test_not_a_number_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert nan_to_null(df).where("v IS NULL").count() == 2


def test_sinks(spark, put, tmp_path):
    loaded = load_table(spark, put("sink.csv", "a,b\n1,x\n1,x\n2,y\n3,z,9\n"))
    result = apply_cleaning(loaded.data, propose_cleaning(loaded.data), "safe")
    write_cleaning(result, str(tmp_path / "out"))
    write_quarantine(loaded, str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "out/data")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/actions")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out/summary")).first()["rows_after"] == 2
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_json_lines_and_mixed_layouts(spark, put):
    lines = load_table(spark, put("plain/lines.json", "".join(f'{{"a":{i},"data":[1]}}\n' for i in range(100))))
    assert lines.data.count() == 100 and lines.notes == ()
    put("mixed/a.json", '{"data":[{"a":1},{"a":2}]}')
    put("mixed/b.json", '{"records":[{"a":3}],"data":[{"a":99}]}')
    put("mixed/c.json", '[{"a":4},\n {"a":5}]')
    put("mixed/d.json", '{"a":6}\n{"a":7}\nnot json\n')
    put("mixed/f.json", '[{"a":9}, 10, null]')
    folder = put("mixed/e.json", '{\n "a": 8\n}').rsplit("/", 1)[0]
    loaded = load_table(spark, folder, "json")
    assert rows(loaded.data) == [(i,) for i in range(1, 10)]
    assert sorted(str(r[0]) for r in loaded.quarantined.collect()) in (["10", "None", "not json"], ["10", "not json", "null"])
    assert sum("list field" in n for n in loaded.notes) == 2


def test_json_beyond_doubles_and_malformed(spark, put):
    loaded = load_table(spark, put("big.json", '[{"a":9007199254740993,"b":{"c":[{"d":1}]}}]'))
    assert loaded.data.columns == ["a", "b.c"] and loaded.data.first()[0] == 9007199254740993
    broken = load_table(spark, put("broken.json", '{"a":1}\n{"a":\n{"a":3}\n'))
    assert rows(broken.data) == [(1,), (3,)] and rows(broken.quarantined) == [('{"a":',)]


def test_compressed_and_unknown_names(spark, put):
    import gzip

    assert rows(load_table(spark, put("x.json.gz", gzip.compress(b'{"a":1}\n{"a":2}\n'))).data) == [(1,), (2,)]
    assert rows(load_table(spark, put("x.tsv.gz", gzip.compress(b"a\tb\n1\tx\n"))).data) == [(1, "x")]
    for name in ("a.docx", "b.orc", "c.xls.gz"):
        with pytest.raises(ValueError):
            detect_format(name)


def test_quoted_line_breaks_without_a_switch(spark, put):
    loaded = load_table(spark, put("breaks.csv", 'a,b\n"one\ntwo, ""three""",1\nx,2\n3,4,5\n'))
    assert rows(loaded.data) == [('one\ntwo, "three"', 1), ("x", 2)] and loaded.quarantined.count() == 1


def test_headers_in_another_order(spark, put):
    put("orders/a.csv", "a,b\n1,2\n")
    put("orders/b.csv", "b,a\nz,3\n")
    put("orders/d.csv", "a,b\n5,é\n".encode("latin-1"))
    folder = put("orders/c.csv", "b,c\nq,7\n").rsplit("/", 1)[0]
    loaded = load_table(spark, folder, "csv")
    assert loaded.data.columns == ["a", "b", "c"]
    assert {tuple(r) for r in loaded.data.collect()} == {(1, "2", None), (3, "z", None), (5, "é", None), (None, "q", 7)}
    assert any("different headers" in n for n in loaded.notes)


def test_loaded_rows_are_read_from_parquet(spark, put):
    loaded = load_table(spark, put("once.csv", "a,b\n1,2\n"))
    plan = loaded.data._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan and "csv" not in plan.replace("once.csv", "")


def test_released_rows_are_gone(spark, put):
    loaded = load_table(spark, put("gone.csv", "a,b\n1,2\n"))
    files = loaded.data.inputFiles()
    assert files and all("/siftwell-" in f for f in files)
    loaded.release()
    with pytest.raises(Exception):
        spark.read.parquet(*files).count()


def test_json_lines_among_bad_ones(spark, put):
    """Good lines are rows however few they are and whatever the first line holds; only one whole value is a document."""
    good = [f'{{"a":{i}}}' for i in range(40)]
    few = load_table(spark, put("few.json", "".join(f"{x}\nbad\n" for x in good) + "bad\n" * 20))
    assert sorted(rows(few.data)) == [(i,) for i in range(40)] and few.quarantined.count() == 60
    for first in ("[INFO] start", "[1] start", "[1]", '{"a":', "{"):
        for last in ("bad", "]", "}", '{"a":41}'):
            loaded = load_table(spark, put(f"f{abs(hash((first, last)))}.json", "\n".join([first, "bad", "bad", *good[:2], "bad", last])))
            expected = [(0,), (1,)] + [(41,)] * (last == '{"a":41}')
            assert sorted(rows(loaded.data)) == expected and loaded.quarantined.count() == 7 - len(expected)
    twice = load_table(spark, put("twice.json", '{"a":1} {"a":2}\n{"a":3}\n'))
    assert rows(twice.data) == [(3,)] and [r[0] for r in twice.quarantined.collect()] == ['{"a":1} {"a":2}']
    pretty = load_table(spark, put("pretty.json", '[\n{"a":1}\n,\n{"a":2}\n]\n'))
    assert sorted(rows(pretty.data)) == [(1,), (2,)] and pretty.quarantined.count() == 0


def test_a_document_is_not_carried_beside_its_records(spark, tmp_path):
    """When each record came with the whole document, a few megabytes took minutes."""
    records = ",".join(f'{{"a": {i}, "b": {{"c": "x{i}"}}}}' for i in range(60_000))
    (tmp_path / "large.json").write_text(f'{{"meta": 1, "data": [{records}]}}')
    loaded = load_table(spark, str(tmp_path / "large.json"))
    assert loaded.data.count() == 60_000 and loaded.data.columns == ["a", "b.c"]


DOCUMENTS = {
    "list": '[{"a": 1}, {"a": 2}\n, {"a": 3}]\n',
    "mixed": '[10, {"a": {"b": 1}}, null, "x}y", [{"a": 9}], {"a": {"b": 2}}, 7]',
    "empty": "[]", "empty_object": "{}", "scalars": "[1, 2]", "blank": "[ \n ]", "empties": "[{}, {}]",
    "envelope": '{"meta": {"n": {"x": 1}}, "data": [{"a": 1, "t": [1, {"u": []}]}, {"a": 2}], "more": [{"z": 1}]}',
    "order": '{"items": [{"a": 1}], "rows": [{"a": 2}, {"a": 3}], "x": {"records": [{"a": 4}]}}',
    "strings": '[{"a": "}{][\\\\"}, {"a": "\\"}, {"}, {"a": "é😀}", "b": "{\\"data\\": ["}, {"a": "x\\\\\\"}"}]',
    "keys": '{"da}ta": [{"a": 1}], "not": "data", "data" : [{"a": "😀}"}, {"a": "y"}], "end": "}"}',
    "no_list": '{"a": 1, "data": {"b": [{"c": 1}]}}',
    "null_list": '{"records": null, "data": [{"a": 1}]}',
    "bom": '\ufeff[{"a": 1}, {"a": 2}]', "pretty": '{\n "data": [\n  {"a": 1},\n  {"a": 2}\n ]\n}\n',
    "lines": '{"data": [{"a": 1}]}\n{"data": [{"a": 2}]}\n', "two": '{"data": [{"a": 1}]} {"data": [{"a": 2}]}',
    "comma": '[{"a": 1},\n]', "twice": '[{"a": 1},, {"a": 2}]', "missing": '[{"a": 1} {"a": 2}]', "first": '[, {"a": 1}]',
    "wrong": '[{"a": [1}], {"a": 2}]', "open": '{"data": [{"a": 1}, {"a": 2}}', "long": '[{"a": 1}]]', "tail": '{"data": [{"a": 1}]} x}',
    "bad_frame": '{"meta": nope, "data": [{"a": 1}, {"a": 2}]}', "bad_entry": '[{"a": 1}, {a: 2}]', "close": '[{"a": 1}, {"a": 2}',
}


def test_documents_in_pieces_are_what_whole_ones_are(spark, put, monkeypatch):
    """All shapes cut into entries, in splits of four bytes and in one, against the same files parsed whole."""

    def outcome(names, **options):
        folder = uuid.uuid4().hex
        for name in names:
            path = put(f"{folder}/{name}.json", DOCUMENTS[name])
        loaded = load_table(spark, path.rpartition("/")[0], "json", **options)
        return rows(loaded.data.select(F.to_json(F.struct("*")))), sorted(str(r[0]) for r in loaded.quarantined.collect()), loaded.notes

    whole = outcome(DOCUMENTS)
    assert len(whole[0]) > 20 and len(whole[1]) > 10
    assert outcome(DOCUMENTS, whole_bytes=0) == whole
    pieces_of = documents.pieces_of

    def small_splits(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        try:
            return pieces_of(*args)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")

    monkeypatch.setattr(documents, "pieces_of", small_splits)
    assert outcome(DOCUMENTS, whole_bytes=0) == whole


def test_a_large_document_is_read_by_many_tasks(spark, tmp_path):
    records = ",".join(f'{{"a": {i}, "b": {{"c": "x{i}"}}}}' for i in range(60_000))
    (tmp_path / "large.json").write_text(f'{{"meta": 1, "data": [{records}]}}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        files = spark.createDataFrame([(f"file:{tmp_path}/large.json", 2)], "file string, level int")
        pieces = documents.pieces_of(spark, str(tmp_path / "large.json"), files)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert pieces.select("block").distinct().count() > 8
    loaded = load_table(spark, str(tmp_path / "large.json"), whole_bytes=1 << 20)
    assert loaded.data.agg(F.count("*"), F.sum("a"), F.countDistinct("`b.c`")).first() == (60_000, 60_000 * 59_999 // 2, 60_000)


def test_a_long_line_is_never_held_whole(spark, tmp_path, monkeypatch):
    """A document of one line is read in pieces only, also where files are told apart."""
    records = ",".join(f'{{"a": {i}}}' for i in range(5_000))
    (tmp_path / "line.json").write_text(f'{{"meta": 1, "data": [{records}]}}')
    text = DataFrameReader.text

    def in_pieces(self, paths, wholetext=False, lineSep=None):
        assert lineSep == "}" and not wholetext
        return text(self, paths, lineSep=lineSep)

    monkeypatch.setattr(DataFrameReader, "text", in_pieces)
    assert load_table(spark, str(tmp_path / "line.json"), whole_bytes=1 << 10).data.agg(F.count("*"), F.sum("a")).first() == (5_000, 2_500 * 4_999)


def test_a_large_document_is_written_in_runs(spark, tmp_path):
    """One file and one value, also of no records, without all records in one row."""
    for n in (0, 1, 30_000):
        records = spark.range(0, n, 1, 3).select(F.to_json(F.struct("id")).alias("value"))
        _write_document(records, str(tmp_path / str(n)), '{"data":[', "]}", "", " ")
        (file,) = (tmp_path / str(n)).glob("part-*")
        assert sorted(r["id"] for r in json.loads(file.read_text())["data"]) == list(range(n)) and "\n" not in file.read_text()


def test_a_compressed_document_is_cut_by_many_tasks(spark, tmp_path):
    """Streams of bzip2 that end anywhere, in records and in strings with braces, give what the plain document gives."""
    rng = random.Random(7)
    bits = ["a", "}", "{", '\\"', "[", "]", ",", " ", "\\\\", "é", "😀"]
    records = [f'{{"a": {i}, "b": {{"c": "{"".join(rng.choice(bits) for _ in range(rng.randrange(30)))}"}}, "t": [{{}}, {{"u": "}}"}}]}}' for i in range(400)]
    text = f'{{"meta": {{"n": 1}}, "data": [7, {", ".join(records)}, null], "more": [{{"z": 1}}, {{"z": 2}}]}}'.encode()
    cuts = [0, *sorted(rng.sample(range(1, len(text)), 40)), len(text)]
    (tmp_path / "plain.json").write_bytes(text)
    (tmp_path / "packed.json.bz2").write_bytes(b"".join(bz2.compress(text[a:b], 1) for a, b in zip(cuts, cuts[1:])))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        files = spark.createDataFrame([(f"file:{tmp_path}/packed.json.bz2", 2)], "file string, level int")
        assert documents.pieces_of(spark, str(tmp_path / "packed.json.bz2"), files).select("block").distinct().count() > 6
        plain, packed = (load_table(spark, str(tmp_path / f), "json", whole_bytes=1 << 10) for f in ("plain.json", "packed.json.bz2"))
        outcomes = [(sorted(map(str, x.data.collect())), sorted(map(str, x.quarantined.collect())), x.notes) for x in (plain, packed)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert outcomes[0] == outcomes[1] and [len(x) for x in outcomes[0][:2]] == [400, 2]
    assert load_table(spark, str(tmp_path / "plain.json")).data.agg(F.sum("a"), F.sum(F.length("`b.c`"))).first() == packed.data.agg(F.sum("a"), F.sum(F.length("`b.c`"))).first()


def test_a_packed_document_is_one_value_and_small(spark, tmp_path):
    for n in (0, 1, 30_000):
        records = spark.range(0, n, 1, 3).select(F.to_json(F.struct("id", F.lit("é}").alias("s"))).alias("value"))
        _write_packed_document(records, str(tmp_path / str(n)), '{"data":[null', "]}")
        (file,) = (f for f in (tmp_path / str(n)).iterdir() if f.name[0] not in "._")
        text = bz2.decompress(file.read_bytes())
        assert json.loads(text)["data"][0] is None and sorted(r["id"] for r in json.loads(text)["data"][1:]) == list(range(n))
        assert file.name.endswith(".bz2") and (n < 10 or file.stat().st_size < len(text) / 5)


def test_texts_of_a_document_are_written_once(spark, tmp_path, monkeypatch):
    """Entries that are objects by themselves are neither copied nor written again on their way to be loaded."""
    rng, folders = random.Random(3), []
    records = ",".join(f'{{"a": {i}, "b": "{rng.getrandbits(320):x}"}}' for i in range(30_000))
    (tmp_path / "large.json").write_text(f'{{"meta": 1, "data": [{records}]}}')
    staged = documents.staged

    def counted(df, *options):
        written = staged(df, *options)
        folders.extend({f.removeprefix("file://").rpartition("/")[0] for f in written.inputFiles()})
        return written

    monkeypatch.setattr(documents, "staged", counted)
    monkeypatch.setattr(readers, "staged", counted)
    loaded = load_table(spark, str(tmp_path / "large.json"), whole_bytes=1 << 20)
    assert loaded.data.count() == 30_000
    written = sum(f.stat().st_size for d in set(folders) for f in Path(d).glob("*.parquet"))
    assert written < (tmp_path / "large.json").stat().st_size


def test_pieces_get_their_places_where_they_are_read(spark, tmp_path):
    """No piece is sorted or moved to learn its depth and entry, which go on over the splits."""
    records = ",".join(f'{{"a": {i}, "b": {{"c": "}}x{i}"}}}}' for i in range(2_000))
    (tmp_path / "large.json").write_text(f'{{"meta": 1, "data": [{records}]}}')
    files = spark.createDataFrame([(f"file:{tmp_path}/large.json", 2)], "file string, level int")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        places = documents.placed(documents.pieces_of(spark, str(tmp_path / "large.json"), files))
        assert places.select("block").distinct().count() > 4
        # Three braces to a record, one of them in a string.
        sizes = places.groupBy("entry").count().where("entry < 2000").select("count").distinct().collect()
        assert [r[0] for r in sizes] == [3]
        # Texts come along, so they need not be joined to their places.
        assert "value" in places.columns and "SortMergeJoin" not in places._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_record_too_large_is_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MOST_VALUE_BYTES", 20)
    (tmp_path / "d.json").write_text('{"a": 1, "b": 2, "c": {"d": 3}}')
    with pytest.raises(ValueError, match="d.json"):
        load_table(spark, str(tmp_path / "d.json"), whole_bytes=10)
    (tmp_path / "f.json").write_text('{"data": [{"a": 1}], "other": [1, 2, 3, 4, 5]}')
    with pytest.raises(ValueError, match="f.json"):
        load_table(spark, str(tmp_path / "f.json"), whole_bytes=10)
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert load_table(spark, str(tmp_path / "l.json"), whole_bytes=10).data.count() == 3
    (tmp_path / "m.json").write_text('[{"a": 1}, {"a": 2}, {"a": 3}]')
    assert load_table(spark, str(tmp_path / "m.json"), whole_bytes=10).data.count() == 3


def awkward_records(newline: str) -> str:
    """Quotes within fields, line breaks, separators and doubled quotes within quotes, rows too long or too short."""
    rng = random.Random(5)
    bits = ["a", '"', ",", "\n", "x y", "é", '""', "\t", " ", "q"]
    lines = ['k,v,"w\nw"']
    for i in range(300):
        value = "".join(rng.choice(bits) for _ in range(rng.randrange(12))).replace('"', '""')
        lines.append(
            (f'{i},5" pipe,x"y', f'{i},"{value}",z', f'{i},"{value}","{value[::-1]}"', f"{i},s,t,u" if i % 3 else f"{i},only")[i % 4]
        )
        lines += [""] * (i % 50 == 0)
    return "\n".join(lines).replace("\n", newline) + newline


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("charset", ["utf-8", "latin-1"])
def test_records_cut_by_splits_are_what_whole_files_give(spark, put, monkeypatch, newline, charset):
    path = put("awkward.csv", awkward_records(newline).encode(charset))
    monkeypatch.setattr(delimited, "SPLITTABLE", ())
    whole = load_table(spark, path)
    monkeypatch.undo()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 10
        cut = load_table(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(str, cut.data.collect())) == sorted(map(str, whole.data.collect()))
    assert sorted(map(str, cut.quarantined.collect())) == sorted(map(str, whole.quarantined.collect()))
    assert cut.notes == whole.notes and cut.data.dtypes == whole.data.dtypes


def test_a_record_over_many_splits_and_files_of_several_kinds(spark, put, tmp_path):
    long = "\n".join(f'line {i}, "{"x" * 100}"' for i in range(1000))
    text = 'a,b\n1,"' + long.replace('"', '""') + '"\n2,"p\nq"\n3,\n'
    put("kinds/one.csv", text)
    put("kinds/two.csv", 'b,a\n"r\ns",4\n')
    put("kinds/three.csv", "a,b\n5,plain\n")
    put("kinds/four.csv", b'a,b\r6,"t\ru"\r')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        loaded = load_table(spark, str(tmp_path / "kinds"), "csv")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    found = {r.a: r.b for r in loaded.data.collect()}
    assert found.pop(6) in ("t\nu", "t\ru")
    assert found == {1: long, 2: "p\nq", 3: None, 4: "r\ns", 5: "plain"}
