"""Work that must follow the input: words are split once, texts aren't dealt to a fixed number of tasks, lines are parsed once."""

import random

from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def write(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def test_words_of_an_answer_are_split_once(spark):
    from millrace.operators import learning as L

    rows = spark.createDataFrame([("a b c a b c",), ("a b",), ("",), (None,), (" x  y z w ",)], "a string")
    out = rows.select(L.reward("no_repeat", F.col("a")).alias("r"))
    assert plan(out).count("split(") == 1
    assert [r["r"] for r in out.collect()] == [0.75, 1.0, 1.0, 1.0, 1.0]


def test_zstd_files_follow_the_text(spark, tmp_path, monkeypatch):
    """A file is one task's; with a limit of 1 kB a file, 60 kB of text go to some sixty files, not six."""
    from millrace.plans import QUERIES
    from millrace.sources import zstd_lines as Z

    rnd = random.Random(4)
    write(spark, tmp_path, "documents", [(i, "en", "".join(rnd.choices("abcdef ", k=600))) for i in range(100)], "doc_id long, lang string, text string")
    monkeypatch.setattr(Z, "FILE_BYTES", 1000, raising=False)
    files, plain = [], Z.write_zstd_lines
    monkeypatch.setattr(Z, "write_zstd_lines", lambda lines, path, *a: (files.append(lines.rdd.getNumPartitions()), plain(lines, path, *a)))
    assert [tuple(r) for r in QUERIES["src8_zstd_lines"](spark, str(tmp_path)).collect()] == [("en", 100, 60_000, 100)]
    assert files[0] >= 30


def test_census_deals_no_texts_to_five_tasks(spark, tmp_path, monkeypatch):
    from millrace.plans import QUERIES

    write(spark, tmp_path, "documents", [(i, f"text number {i} " * 5) for i in range(40)], "doc_id long, text string")
    dealt, kind = [], type(spark.range(0))
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *c: (dealt.append(n), plain(self, n, *c))[1])
    got = {r["counter"]: r["n"] for r in QUERIES["src6_census_counters"](spark, str(tmp_path)).collect()}
    assert got["physical_rows"] == 40 and got["eligible_rows"] == 36 and not dealt


def test_metric_lines_are_parsed_once(spark, monkeypatch):
    from millrace.operators import series as V
    from millrace.plans import QUERIES

    seen, plain = [], V.compare_runs
    monkeypatch.setattr(V, "compare_runs", lambda metrics, *a: (seen.append(plan(metrics)), plain(metrics, *a))[1])
    assert QUERIES["evl9_run_comparison"](spark, "/root/testdata/sf0.001").count() > 0
    assert "parse_json" not in seen[0]


def test_shards_are_unpacked_one_at_a_time():
    """4,000 shards of 8 kB in one batch: Python's own copies stay far below the batch."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from millrace.sources import release as R

    data = np.arange(4096, dtype="<u2").tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array(["train"] * 4000), pa.array(range(4000)), pa.array([data] * 4000, pa.binary())], ["split", "shard", "data"])
    tracemalloc.start()
    n = 0
    for out in R.unpack_shards([batch], "<u2", 4096):
        assert out["start"][0].as_py() == 4096 * n and len(out["ids"][0]) == 4096
        n += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 and peak < batch.nbytes / 8
    print("peak bytes", peak)


def test_text_rules_scan_each_text_few_times(spark):
    """First lines aren't found by splitting whole texts, single spaces and letters aren't replaced one by one; values are those of the plain forms."""
    import re

    from millrace.functions import text as T

    rnd = random.Random(9)
    alphabet = list("ab Z9_.-=<>&;/:\t\n\n\r  \x00\x0b\x1c\x85\xa0  ​﻿“’é漢😀") + ["www.", "https://", "home", "Cookies ", "&amp;", "<p>"]
    texts = ["", " ", "\n\n", "é", "a", "\x85\n x \n", None] + ["".join(rnd.choices(alphabet, k=rnd.randrange(1, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    x = F.col("x")
    out = rows.select(
        "x", T.first_line(x).alias("first"), T.normalise(x).alias("normal"), T.normalise_lines(x, leading_noise=False).alias("lines"), T.ascii_share(x).alias("ascii"), T.symbol_share(x).alias("symbols"),
        T.letter_share(x).alias("letters"), T.menu_hits(x).alias("menu"), T.url_density(x).alias("urls"), T.html_units(x).alias("html"),
    )
    blank = T._BLANK
    share = lambda v, pattern: len(re.sub(pattern, "", v)) / len(v) if v else 0.0
    for r in out.collect():
        v = r["x"]
        if v is None:
            assert (r["first"], r["normal"], r["lines"]) == (None, None, None)
            continue
        assert r["first"] == next((p for p in (q.strip(T.SPACES) for q in v.split("\n")) if p), ""), repr(v)
        plain = re.sub("\r\n?", "\n", v)
        assert r["normal"] == re.sub("[​-‍﻿\x00-\x08\x0b\x0c\x0e-\x1f]", "", plain), repr(v)
        quotes = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "", plain).translate(str.maketrans(T.QUOTES_FROM, T.QUOTES_TO))
        tidy = re.sub(rf"{blank}+\n", "\n", re.sub("[ \t]+", " ", quotes)).strip(T.SPACES)
        assert r["lines"] == re.sub("_{4,}", " ", tidy).strip(T.SPACES), repr(v)
        assert r["ascii"] == share(v, r"[^\x00-\x7F]") and r["symbols"] == share(v, rf"[^\W_]|[{T._SPACE_CLASS}]"), repr(v)
        assert r["letters"] == len([c for c in v if c.isalpha()]) / max(1, len(v)), repr(v)
        assert r["menu"] == len(re.findall(rf"(?i)\b(?:{T.MENU_WORDS})\b", v)), repr(v)
        assert r["urls"] == (len(re.findall(T.URL, v)) / len(v) if v else 0.0), repr(v)
        assert r["html"] == ((len(re.findall("<[^>]{1,200}>", v)) + 0.5 * len(re.findall("&[a-zA-Z]{2,10};", v))) / len(v) if v else 0.0), repr(v)
    assert "split(" not in plan(rows.select(T.head_label(x)))
    assert "_{20,}" not in plan(rows.select(T.has_filler(x)))


def test_stream_texts_are_hashed_once(spark):
    """What puts documents in order is written; before, each of its two readers counted the words and hashed the texts again."""
    from millrace.plans.release_queries import streams

    out = streams(spark, "/root/testdata/sf0.001")
    assert "sha2(" not in plan(out) and out.count() > 0


def test_block_masks_make_ids_once(spark):
    """The words of a text are hashed in one place of the plan; before, a filter on the size of the ids hashed them again."""
    from millrace.operators import learning as L
    from millrace.plans import QUERIES

    assert plan(QUERIES["pck3_block_masks"](spark, "/root/testdata/sf0.001")).count("md5(") == 1
    runs = spark.createDataFrame([("t", 0, [1, 2]), ("t", 2, []), ("t", 2, None), ("t", 2, [1, 9, 2])], "split string, start long, ids array<int>")
    assert [(r["block"], r["ids"], r["labels"]) for r in L.masked_blocks(runs, 2, 1, 2).orderBy("block").collect()] == [(0, [1, 2], [2, 1]), (1, [1, 9], [9, 2])]
