"""Chat formatting with a grammar round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The template: OPEN role SEP text CLOSE newline, turn after turn.
OPEN, SEP, CLOSE = "### ", ": ", "</turn>"
#: Escapes, applied in this order; undone in the reverse one. Each begins with the
#: first one's string, and none holds another's, so undoing is unambiguous.
TEXT_ESCAPES = (("\\", "\\0"), (CLOSE, "\\1"), (OPEN, "\\2"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (SEP, "\\3"))


def _escape(c: Column, pairs) -> Column:
    for raw, code in pairs:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def _unescape(c: Column, pairs) -> Column:
    for raw, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def unescape_text(c: Column) -> Column:
    """A turn's text from its rendered form."""
    return _unescape(c, TEXT_ESCAPES)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SEP), text, F.lit(CLOSE + "\n"))


def parse(rendered: Column) -> Column:
    """The grammar's parser: array of (role, text), in order; null for what is no
    sequence of turns. A turn runs from OPEN to the next OPEN and ends in CLOSE and a
    newline; CLOSE nowhere else; the role ends at the first SEP."""
    pieces = F.split(rendered, OPEN)
    inner = F.slice(pieces, 2, F.size(pieces))
    body = lambda p: F.substring(p, F.lit(1), F.char_length(p) - F.lit(len(CLOSE) + 1))
    good = (F.get(pieces, F.lit(0)) == "") & F.forall(
        inner, lambda p: F.endswith(p, F.lit(CLOSE + "\n")) & ~F.contains(body(p), F.lit(CLOSE)) & F.contains(body(p), F.lit(SEP)))

    def turn(p: Column) -> Column:
        at = F.locate(SEP, p)
        return F.struct(_unescape(F.substring(p, F.lit(1), at - 1), ROLE_ESCAPES).alias("role"),
                        _unescape(F.substring(p, at + len(SEP), F.char_length(p)), TEXT_ESCAPES).alias("text"))

    return F.when(good, F.transform(inner, lambda p: turn(body(p))))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", *, loss_role: str = "assistant") -> DataFrame:
    """(id_col, formatted, loss_spans array<struct<start, end>>) for every conversation.

    Turns are in order of ``turn_col`` (null first; ties by role, then text; repeated
    rows are repeated turns). Null texts and roles are empty. Spans are code point
    positions [start, end) in ``formatted`` of the texts of ``loss_role``. Rows with a
    null id are one conversation. An empty table returns no rows. Other columns are
    ignored.

    Method. Each turn is rendered as it is and reparsed by the grammar; where the
    parser does not give back the source's role and text, they are escaped and tried
    again. That is row by row. As OPEN stands only at the beginning of such a turn and
    CLOSE only at its end, turns that survive alone survive side by side; still the
    whole conversation is reparsed and compared with the source, and a difference
    raises an error. A conversation is one text, so its turns must meet in one row;
    nothing else of it is gathered, and positions come from a running sum over turns.
    """
    t = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    out = None
    for role, text in reversed([(F.col("role"), F.col("text")), (_escape(F.col("role"), ROLE_ESCAPES), _escape(F.col("text"), TEXT_ESCAPES))]):
        this = F.struct(render(role, text).alias("piece"), F.char_length(role).alias("role_chars"), F.char_length(text).alias("text_chars"))
        out = this if out is None else F.when(parse(this["piece"]).eqNullSafe(source), this).otherwise(out)
    t = t.withColumn("r", out).select("id", "turn", "role", "text", "r.*")
    w = W.partitionBy("id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.char_length("piece")).over(w)
    t = t.withColumn("upto", end.cast("long"))
    start = F.col("upto") - F.char_length("piece") + len(OPEN) + F.col("role_chars") + len(SEP)
    row = F.struct("turn", "role", "text", "upto", "piece", start.alias("start"), (start + F.col("text_chars")).alias("end"))
    g = t.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    g = g.withColumn("formatted", F.array_join(F.transform("rows", lambda r: r["piece"]), ""))
    same = parse(F.col("formatted")).eqNullSafe(F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))))
    spans = F.transform(F.filter("rows", lambda r: r["role"] == loss_role), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return g.select(F.col("id").alias(id_col),
                    F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")).cast("string")).alias("formatted"),
                    spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
