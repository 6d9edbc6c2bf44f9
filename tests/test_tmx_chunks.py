"""Files cut by chunks give what whole documents give, wherever the borders fall."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from test_tmx import BROKEN, CASES, HEAD, MARKUP, TAIL, document, files_df, unit
from tunedata.sources.tmx import TU_PATTERN, parse_tmx, read_tmx_errors, read_tmx_segments, tmx_errors
from tunedata.sources.tmx_chunks import CLOSE, OPEN, END, STATES, _Reader, scan_tmx, transitions, walk

PIECES = ["<tu>", "<tu a='>'>", '<tu b="/>"/>', "<tu/>", "<tuv>", "</tuv>", "</tu>", "</tu\n>", "<!-- <tu> </tu> -->", "<!-->x-->", "<![CDATA[</tu><!--]]>",
          "<?p <tu> ?>", "text", " \n ", "-->", "]]>", "?>", ">", "ü€😀", "<b>"]


def borders(text, size):
    cuts = {0, len(text)}
    for at in range(size, len(text), size):
        i = text.find("<", at)
        if i >= 0:
            cuts.add(i)
    cuts = sorted(cuts)
    return [text[i:j] for i, j in zip(cuts, cuts[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.integers(1, 40))
def test_chunks_compose_to_the_whole(text, size):
    whole = transitions(text)
    for start in range(STATES):
        state, n, rest = start, 0, ""
        for chunk in borders(text, size):
            ends, opens, rests = transitions(chunk)
            state, n, rest = ends[state], n + opens[state], rest + rests[state]
        assert (state, n) == (whole[0][start], whole[1][start])
        assert re.sub(r"\s+", " ", rest) == whole[2][start]
        assert (n, state) == (sum(k == OPEN for k, _ in walk(text, start)), next(p for k, p in walk(text, start) if k == END))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_units_equal_the_pattern(text):
    opened, found = None, []
    for kind, p in walk(text, 0):
        if kind == OPEN:
            opened = p
        elif kind == CLOSE:
            found.append(text[opened:p])
            opened = None
    want = [m.group(1) for m in re.finditer(TU_PATTERN, text, re.ASCII) if m.group(1)]
    assert found == want[: len(found)]
    if opened is None:  # a unit that never ends takes the rest of the document with it
        assert found == want
        ends, _, rests = transitions(text)
        assert ends[0] == 0 and rests[0] == re.sub(r"\s+", " ", re.sub(TU_PATTERN, "", text, flags=re.ASCII), flags=re.ASCII)


def rows(df):
    name = F.regexp_extract("path", r"([^/]+)\.tmx$", 1)
    return sorted(map(tuple, df.withColumn("path", F.when(F.col("path").contains("/"), name).otherwise(F.col("path"))).collect()), key=str)


@pytest.mark.parametrize("encoding,chunk", [("UTF-16LE", 128), ("UTF-8", 100)])
def test_files_give_the_rows_of_documents(spark, tmp_path, encoding, chunk):
    docs = {k: d for k, (d, _) in MARKUP.items()} | {name: document(units, bom=False) for name, units in CASES}
    docs["long"] = HEAD + unit("u" * 3000) + unit("ü€😀" * 50) + "<!-- " + unit("no") * 40 + " -->" + unit("z") + TAIL
    for name, d in docs.items():
        (tmp_path / f"{name}.tmx").write_bytes(d.encode(encoding))
    files = spark.createDataFrame([(k, d.encode(encoding)) for k, d in docs.items()], "path string, content binary")
    for policy in ("quarantine", "skip_file"):
        got = read_tmx_segments(spark, str(tmp_path), encoding=encoding, chunk_bytes=chunk, on_error=policy)
        assert rows(got) == rows(parse_tmx(files, encoding=encoding, on_error=policy))
    assert rows(read_tmx_errors(spark, str(tmp_path), encoding=encoding, chunk_bytes=chunk)) == rows(tmx_errors(files, encoding=encoding))


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_broken_files(spark, tmp_path, chunk):
    docs = {**{k: d for k, d in BROKEN.items() if d}, "good": (HEAD + unit("ok") + TAIL).encode("utf-16-le")}
    for name, d in docs.items():
        (tmp_path / f"{name}.tmx").write_bytes(d)
    files = spark.createDataFrame(list(docs.items()), "path string, content binary")
    for policy in ("quarantine", "skip_file"):
        assert rows(read_tmx_segments(spark, str(tmp_path), chunk_bytes=chunk, on_error=policy)) == rows(parse_tmx(files, on_error=policy))
    assert rows(read_tmx_errors(spark, str(tmp_path), chunk_bytes=chunk)) == rows(tmx_errors(files))
    with pytest.raises(ValueError, match="malformed document"):
        read_tmx_segments(spark, str(tmp_path), chunk_bytes=chunk, on_error="fail")


def test_a_comment_without_an_end_takes_the_rest(spark, tmp_path):
    (tmp_path / "x.tmx").write_bytes((HEAD + unit("a") + "<!-- " + unit("b") + TAIL).encode())
    got = read_tmx_segments(spark, str(tmp_path), encoding="UTF-8", chunk_bytes=32).where("lang = 'EN-GB'")
    assert [(r.tu_idx, r.seg_raw) for r in got.collect()] == [(0, "a")]
    assert [r.tu_idx for r in read_tmx_errors(spark, str(tmp_path), encoding="UTF-8", chunk_bytes=32).collect()] == [None]


def test_no_files_and_odd_names(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert read_tmx_segments(spark, str(tmp_path / "empty")).collect() == []
    (tmp_path / "a b%20ü+.tmx").write_bytes((HEAD + unit("a") + TAIL).encode("utf-16"))
    got = read_tmx_segments(spark, str(tmp_path), encoding="UTF-16", chunk_bytes=16).where("lang = 'EN-GB'").collect()
    assert [r.seg_raw for r in got] == ["a"] and got[0].path.endswith("a b%20ü+.tmx")


def test_one_file_is_cut_by_many_tasks(spark, tmp_path):
    text = HEAD + "\n".join(unit(f"s{i} " + "x" * 50) for i in range(400)) + TAIL
    (tmp_path / "one.tmx").write_bytes(text.encode("utf-16-le"))
    scan = scan_tmx(spark, str(tmp_path), chunk_bytes=4096)
    by_task = scan.units.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(F.length("tu")).alias("most")).collect()
    assert sum(r.n for r in by_task) == 400 and 3 <= len(by_task) <= 4 and max(r.most for r in by_task) < 200  # local[4]
    assert scan.documents.select(F.max(F.length("rest")).alias("n")).first().n < 600


def test_border_keeps_characters_whole(tmp_path):
    path = tmp_path / "x"
    path.write_bytes("㰀Ā<ab".encode("utf-16-le"))  # 3C00 and 0100: the bytes 3C 00 also lie across characters
    reader = _Reader(str(path), path.stat().st_size, "UTF-16LE")
    assert [reader.border(i) for i in (0, 2, 4, 6)] == [0, 4, 4, 10]


def test_skip_file_parses_once(spark):
    files = files_df(spark, {"bad": document(CASES[-1][1] + CASES[0][1]), "good": document(CASES[0][1])})
    plan = parse_tmx(files, on_error="skip_file")._jdf.queryExecution().optimizedPlan().toString()
    assert "xmltostructs" not in plan.lower() and "from_xml" not in plan.lower()
