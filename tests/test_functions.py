"""Scalar rules on the boundary values they are about."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import coerce, display, text, urls
from quillspark.functions.absence import is_absent, merge_value


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_absence(spark):
    assert column(spark, [None, "", "x"], "string", lambda v: is_absent(v, T.StringType())) == [True, True, False]
    assert column(spark, [None, [], [1]], "array<int>", lambda v: is_absent(v, T.ArrayType(T.IntegerType()))) == [True, True, False]
    assert column(spark, [None, 0.0, float("nan")], "double", lambda v: is_absent(v, T.DoubleType())) == [True, False, False]


def test_merge_of_structs(spark):
    kind = "struct<a:string,b:struct<n:int,l:array<int>>>"
    rows = spark.createDataFrame([((("x", (1, [1])), ("", (None, []))),), ((("x", (1, [1])), ("y", (0, [2]))),), ((None, ("y", None)),)], f"r struct<o:{kind},n:{kind}>")
    schema = rows.schema["r"].dataType["o"].dataType
    got = [r[0].asDict(True) if r[0] else None for r in rows.select(merge_value(F.col("r.o"), F.col("r.n"), schema)).collect()]
    assert got == [{"a": "x", "b": {"n": 1, "l": [1]}}, {"a": "y", "b": {"n": 0, "l": [2]}}, {"a": "y", "b": None}]


def test_ids_and_numbers(spark):
    assert column(spark, ["1", "1" * 25, "1" * 26, "x", "", None], "string", coerce.record_id) == ["1", "1" * 25, None, None, None, None]
    assert column(spark, ["1.5", "1e400", "nan", "0x10", None], "string", coerce.finite_number) == [1.5, None, None, None, None]
    assert column(spark, ["9007199254740991", "9007199254740993e3", "1.5"], "string", coerce.safe_integer) == [2**53 - 1, None, None]
    assert column(spark, ["@Some_One", "way_too_long_handle_x", "a b"], "string", coerce.handle) == ["Some_One", None, None]
    assert column(spark, ["Wed Oct 10 20:19:24 +0000 2018", "junk"], "string", lambda v: coerce.iso_text(coerce.platform_timestamp(v))) == ["2018-10-10T20:19:24.000Z", None]


def test_counts(spark):
    values = [0.0, 999.0, 1000.0, 1234.0, 9999.0, 12345.0, 1e6, 3.4e6, None, -1.0]
    assert column(spark, values, "double", text.compact_count) == ["0", "999", "1.0K", "1.2K", "10.0K", "12K", "1.0M", "3.4M", "", ""]
    assert column(spark, [0, 61_000, 3_661_000, None], "long", text.duration) == ["0:00", "1:01", "1:01:01", ""]
    assert column(spark, [512, 1536, None], "long", text.byte_count) == ["512 B", "1.5 KB", "\u2014"]


def test_relative_times(spark):
    now = F.lit("2024-03-31 12:00:00").cast("timestamp_ntz")
    ago = lambda v: display.relative_time(v.cast("timestamp_ntz"), now)
    times = ["2024-03-31 12:00:00.000001", "2024-03-31 12:00:00.999999", "2024-03-31 12:00:00", "2024-03-31 11:59:00.000001", "2024-03-31 11:59:00", "2024-03-31 11:00:00.000001", "2024-03-31 11:00:00",
             "2024-03-30 12:00:00.000001", "2024-03-30 12:00:00", "2024-03-01 12:00:00.000001", "2024-03-01 12:00:00", "2024-03-31 12:30:00", "2030-03-31 02:30:59", None]
    labels = ["2024-03-31 12:00", "2024-03-31 12:00", "now", "now", "1 min", "59 min", "1 h", "23 h", "1 d", "29 d", "2024-03-01 12:00", "2024-03-31 12:30", "2030-03-31 02:30", "—"]
    assert column(spark, times, "string", ago) == labels
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # clocks go forward from 2 to 3 on the last day of March
    try:
        assert column(spark, times, "string", ago) == labels
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_text(spark):
    assert column(spark, ["=a", 'say "x"', None], "string", text.csv_cell) == ["'=a", '"say ""x"""', ""]
    assert column(spark, ["Rock #Café_1 #b"], "string", text.hashtags) == [["Café_1", "b"]]
    assert column(spark, [["A", "a", "B", None]], "array<string>", lambda v: text.distinct_ignoring_case(F.array_compact(v))) == [["A", "B"]]
    assert column(spark, ["<p>a <b>b</b>\n c</p>"], "string", text.strip_tags) == ["a b c"]
    assert column(spark, ["a😇b"], "string", lambda v: text.utf16_offset(v, F.lit(2))) == [3]
    spans = [[("url", 0, 5), ("tag", 3, 9), ("who", 5, 7), ("tag", 9, 9), ("tag", None, 3), ("tag", 0, 2)]]
    got = column(spark, spans, "array<struct<kind:string,start:int,end:int>>", text.resolve_spans)[0]
    assert [tuple(s) for s in got] == [("url", 0, 5), ("who", 5, 7)]
    blobs = [bytes.fromhex("89504e470d0a"), b"GIF89a", b"RIFFxxxxWEBP", b"\0\0\0\x18ftypmp42", b"??"]
    assert column(spark, [bytearray(b) for b in blobs], "binary", text.magic_extension) == ["png", "gif", "webp", "mp4", "bin"]


def test_urls(spark):
    assert column(spark, ["https://A.Example.com/x?y#z", "nonsense", None], "string", urls.host) == ["a.example.com", None, None]
    assert column(spark, ["https://example.com/u/status/123?s=1", "https://example.com/u"], "string", urls.permalink_id) == ["123", None]
    assert column(spark, ["a/b.txt", "../x", "/x", "a b", ""], "string", urls.safe_archive_name) == [True, False, False, False, False]
