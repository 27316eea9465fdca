"""Glyph tokens to lines: rows of tokens, packed lines and a plain loop agree."""

from pyspark.sql import functions as F

from folioframe.operators import normalize
from folioframe.sources import synthetic

TEXTS = ["  two words \t", "", " \t ", "é 漢😀x\r", "x" * 3000 + " end", "a", "tab\tin", "​ z", "- b"]


def jumps(p, q):
    if None in (p["y1"], q["y1"]):
        return False
    hp, hq = p["y1"] - p["y0"], q["y1"] - q["y0"]
    if hp <= 0 or hq <= 0:
        return False
    overlap = max(0.0, min(p["y1"], q["y1"]) - max(p["y0"], q["y0"])) / min(hp, hq)
    apart = abs((p["y0"] + p["y1"] - q["y0"] - q["y1"]) / 2)
    tall = max(hp, hq)
    return overlap < 0.2 and apart > 0.8 * tall or overlap >= 0.5 and (q["x0"] - p["x1"] > 6 * tall or p["x0"] - q["x1"] > 2 * tall)


def plain(tokens):
    pages, out = {}, []
    for t in sorted(tokens, key=lambda t: (t["doc_id"] is not None, t["doc_id"] or 0, t["page_index"], t["token_index"])):
        pages.setdefault((t["doc_id"], t["page_index"]), []).append(t)
    for page, toks in pages.items():
        lines, own, last = [], None, None
        for t in toks:
            ink = t["kind"] == "glyph" and t["text"] not in (" ", "\t")
            if t["kind"] == "line_break":
                own = last = None
            else:
                if ink and (last is None or jumps(last, t)):
                    lines.append(own := ["", []])
                if own:
                    own[0] += t["text"]
                    own[1] += [t] if ink else []
            last = t if ink else last
        for i, (text, box) in enumerate(lines):
            low = [t["y1"] for t in box if t["y1"] is not None]  # a document without an id has no line heights
            out.append((*page, text, min(t["x0"] for t in box), min(t["y0"] for t in box), max(t["x1"] for t in box), max(low, default=None), i))
    return out


def got(df):
    assert df.columns == ["doc_id", "page_index", "text", "x0", "y0", "x1", "y1", "line_index"]
    return sorted(map(repr, map(tuple, df.collect())))


def test_packed_lines_and_token_rows_agree(spark, monkeypatch):
    docs = [(i, "\n".join(TEXTS[i % 5 :] * (1 + i % 3)), None if i == 5 else "en") for i in range(12)] + [(12, None, "en"), (13, "", "en"), (None, "no id\nhere", "en")]
    lines = synthetic.lines(spark.createDataFrame(docs, "doc_id long, text string, lang string")).cache()
    tokens = synthetic.tokens(lines)
    want = sorted(map(repr, plain([r.asDict() for r in tokens.collect()])))
    assert len(want) > 100
    assert got(normalize.glyphs_to_lines(tokens)) == want
    for size in (1, 64, 1 << 20):  # pages that are cut anywhere keep their numbers
        monkeypatch.setattr(normalize, "PART_BYTES", size)
        assert got(normalize.glyphs_to_lines(lines.coalesce(1), "line_index", synthetic.glyphs)) == want


def test_tokens_that_jump_on_a_page(spark):
    rows = [(1, 0, i, "glyph", c, 10.0 * i + jump, float(y), 10.0 * i + 8 + jump, float(y + h)) for i, (c, jump, y, h) in enumerate([("a", 0, 0, 10), ("b", 0, 0, 10), (" ", 0, 0, 10), ("c", 500, 0, 10), ("d", 500, 50, 10), ("e", 0, 50, 10), ("f", 0, 50, 0), ("g", 900, 90, 10)])]
    rows += [(1, 1, 0, "line_break", "\n", 0.0, 0.0, 0.0, 0.0), (1, 2, 0, "glyph", " ", 0.0, 0.0, 0.0, 0.0)]
    tokens = spark.createDataFrame(rows, "doc_id long, page_index int, token_index long, kind string, text string, x0 double, y0 double, x1 double, y1 double")
    assert got(normalize.glyphs_to_lines(tokens)) == sorted(map(repr, plain([r.asDict() for r in tokens.collect()])))
    assert normalize.glyphs_to_lines(tokens.where("false")).count() == 0
    assert normalize.glyphs_to_lines(tokens).where(F.col("page_index") > 0).count() == 0


def test_the_query_makes_no_row_a_character(spark, tmp_path):
    """A row a character went through the shuffle: more than 0.81 GB of disk on 0.10 GB."""
    from folioframe.plans.queries import QUERIES

    spark.createDataFrame([(1, "a b c\n d", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["glyphs_to_lines"](spark, str(tmp_path))
    assert [r.text for r in df.orderBy("line_index").collect()] == ["a b c", "d"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
