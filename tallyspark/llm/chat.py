"""Chat formatting in DataFrame functions alone: typed parts become one text a conversation, with masks, attachments and a way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks of a turn: before its role, between role and content, after the content.
OPEN, BETWEEN, CLOSE = "[INST]", "[/INST]", "</s>"
#: The placeholder of each type of part; a type that is not named here is a FILE.
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
FILE = "[FILE]"
#: What texts and roles may not hold as it is.
CONTROL = (OPEN, BETWEEN, "<s>", CLOSE, *PLACEHOLDERS.values(), FILE)
_TAILS = "|".join(sorted({c[1:].replace("]", r"\]") for c in CONTROL}))
#: Tokens that a placeholder stands for: an image's squares of so many pixels a side, an audio's tokens a second, a
#: document's tokens a page, and those of a file of unknown size.
PATCH, PER_SECOND, PER_PAGE, PER_FILE = 16, 12.5, 768, 1
#: Code points of a block in which spans are counted.
BLOCK = 4096
#: A part: its type, the text of a text part, where an attachment lies, and its size.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(c: Column) -> Column:
    r"""Each control string gets a backslash after its first character, and one more if it has some: `</s>`, `<\/s>`."""
    return F.regexp_replace(c, rf"([<\[])(\\*)({_TAILS})", r"$1$2\\$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)\\({_TAILS})", "$1$2$3")


def text_part(c: Column) -> Column:
    """A list of one text part, for tables whose turns have a text alone."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(c.cast("string"), F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def _type(part: Column) -> Column:
    return F.lower(F.coalesce(part["type"], F.when(part["ref"].isNull(), "text").otherwise("file")))


def placeholder(part: Column) -> Column:
    kind = F.lit(FILE)
    for name, mark in PLACEHOLDERS.items():
        kind = F.when(_type(part) == name, mark).otherwise(kind)
    return kind


def tokens(part: Column) -> Column:
    """How many tokens an attachment's placeholder is expanded to; sizes that are null or negative count as none."""
    size = lambda name: F.greatest(F.coalesce(part[name], F.lit(0)), F.lit(0))
    squares = F.ceil(size("width") / PATCH) * F.ceil(size("height") / PATCH)
    found = F.when(_type(part) == "image", squares).when(_type(part) == "audio", F.ceil(size("seconds") * PER_SECOND)).when(_type(part) == "document", size("pages").cast("long") * PER_PAGE)
    return F.coalesce(found, F.lit(PER_FILE)).cast("long")


def visit(parts: Column) -> Column:
    """(content, attachments) of a turn's parts in order.

    Each part is visited once: a text part gives its escaped text, any other
    its placeholder and an attachment (type, ref, tokens).  Null parts and a
    null list are nothing; a part without type is a text, or a file if it has
    a ref.  Texts side by side become one.
    """
    real = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    said = F.transform(real, lambda p: F.when(_type(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(placeholder(p)))
    held = F.transform(F.filter(real, lambda p: _type(p) != "text"), lambda p: F.struct(_type(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    return F.struct(F.array_join(said, "").alias("content"), held.alias("attachments"))


def format_conversations(turns: DataFrame, parts: str = "parts", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, formatted, loss, attachments, n_attached_tokens): a row a conversation.

    turns: conv_id, turn, role and a list of PART.  A turn is [INST] role
    [/INST] content </s>; its content is under the loss mask if its role is in
    `learned`.  loss: (start, length) in code points of each learned content,
    in order, empty ones too; attachments: (turn, type, ref, tokens), turn
    counted from 0.  Turns are ordered by `turn` (nulls first), role and
    content.  A null conv_id is a conversation of its own, a null role an
    empty one; repeated rows are repeated turns; an empty table gives none.
    A conversation is one text, so it is put together in one task; offsets
    come from a running sum, in time in proportion to its turns.
    """
    seen = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), visit(F.col(parts)).alias("v"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BETWEEN))
    lines = seen.select("conv_id", "turn", "role", F.col("v.content").alias("content"), F.col("v.attachments").alias("held"), head.alias("head"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("content")]
    upto = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.length("head") + F.length("content") + len(CLOSE)
    placed = lines.withColumns({"at": (F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1).cast("int"), "start": F.sum(n).over(upto) - F.length("content") - len(CLOSE)})
    one = F.struct(
        "at",
        F.concat("head", "content", F.lit(CLOSE)).alias("line"),
        F.when(F.col("role").isin(*learned), F.struct(F.col("start").cast("long").alias("start"), F.length("content").cast("long").alias("length"))).alias("span"),
        F.transform("held", lambda h: F.struct(F.col("at").alias("turn"), h["type"].alias("type"), h["ref"].alias("ref"), h["tokens"].alias("tokens"))).alias("held"),
    )
    rows = F.array_sort(F.collect_list(one)).alias("x")
    spans = F.filter(F.transform("x", lambda r: r["span"]), lambda s: s.isNotNull())
    held = F.flatten(F.transform("x", lambda r: r["held"]))
    out = placed.groupBy("conv_id").agg(rows).select("conv_id", F.size("x").cast("long").alias("n_turns"), F.array_join(F.transform("x", lambda r: r["line"]), "").alias("formatted"), spans.alias("loss"), held.alias("attachments"))
    return out.withColumn("n_attached_tokens", F.coalesce(F.aggregate("attachments", F.lit(0).cast("long"), lambda a, h: a + h["tokens"]), F.lit(0)))


def read_turns(formatted: Column) -> Column:
    """(role, content) of each turn of a formatted text; contents are still escaped, as placeholders would else be no marks."""
    lines = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(unescape(F.substring(F.split(x, r"\[/INST\]", 2)[0], len(OPEN) + 1, 2**31 - 1)).alias("role"), F.split(x, r"\[/INST\]", 2)[1].alias("content")))


def read_parts(content: Column) -> Column:
    """The texts and placeholders of a turn's content in order: (placeholder or null, text or null); empty texts are left out."""
    marks = "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in (*PLACEHOLDERS.values(), FILE))
    found = F.filter(F.split(content, f"(?={marks})|(?<={marks})", -1), lambda x: x != "")
    is_mark = lambda x: x.rlike(f"^(?:{marks})$")
    return F.transform(found, lambda x: F.struct(F.when(is_mark(x), x).alias("placeholder"), F.when(~is_mark(x), unescape(x)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the mask, in order, cut out where their spans say.

    Counting code points from the beginning for each span would cost the
    square of a long conversation, so it is cut into blocks of BLOCK code
    points once, and each span is cut from the blocks that it touches.
    """
    first = lambda s: F.floor(s["start"] / BLOCK).cast("int")
    touched = lambda s: F.floor((s["start"] + s["length"]) / BLOCK).cast("int") - first(s) + 1
    cut = lambda b, s: F.substring(F.array_join(F.slice(b, first(s) + 1, touched(s)), ""), (s["start"] - F.floor(s["start"] / BLOCK) * BLOCK + 1).cast("int"), s["length"].cast("int"))
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    # A lambda's own variable is computed once, what it refers to outside once an element.
    return F.transform(F.array(blocks), lambda b: F.transform(loss, lambda s: unescape(cut(b, s))))[0]


def digests(found: DataFrame) -> DataFrame:
    """What the formatted texts say when read back: digests of the turns and of the texts under the mask."""
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["content"]), F.lit("\n"))), "")
    learned = F.array_join(read_loss(F.col("formatted"), F.col("loss")), "")
    return found.select("conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def control_conversation(like: DataFrame) -> DataFrame:
    """Conversation -1, whose two turns say control strings, as rows of conversations."""
    rows = like.sparkSession.range(2)
    said = F.lit(f"{CLOSE}{OPEN} ok {BETWEEN}")
    return rows.select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))


#: DuckDB's form of the digests of all conversations and of the one with control strings.
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)({_TAILS})', '\1\2\\\3', 'g') AS safe, regexp_replace(role, '([<\[])(\\*)({_TAILS})', '\1\2\\\3', 'g') AS safe_role FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(safe_role) + length(safe) + {len(OPEN + BETWEEN + CLOSE)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
