"""Chat formatting by quotation linking, in DataFrame expressions only.

Lines that begin with ``>`` marks are quoted, one level for each mark.  A passage is a longest run of
lines of one level.  Passages, their paragraphs and their lines are normalised and hashed, and joined
within the conversation to the first message that has the same paragraph or line as its own words.  The
message a passage links to is the one that explains most of it.  A passage that links to none so is an
excerpt perhaps: its shingles of five words are joined in the same way, and a message that has at least
0.8 of them first is the one.  A reply's parent is the earliest passage's message of the lowest level.
Parents give every message a root and a depth, found by doubling the
steps towards the root, and the messages of a conversation in the order of root, depth and turn
are a conversation in which no reply comes before what it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

QUOTED = r"^\s*>"
#: the line before a quotation that names its author
ATTRIBUTION = r"(wrote|writes|said|schrieb|escribió|écrit)\s*:\s*$"
#: words of a shingle, and the share of an excerpt's shingles that its message has
SHINGLE, CONTAINED = 5, 0.8
#: rounds of doubling: chains of up to 2 ** ROUNDS replies
ROUNDS = 40


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^((?:\s*>)+)", 1), r"[^>]", ""))


def _normal(text: Column) -> Column:
    """Lower case, without quote marks and punctuation, single spaces."""
    bare = F.regexp_replace(F.lower(text), r"^(?:\s*>)+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[\p{P}\p{S}]+", " "), r"\s+", " "))


def unquoted(text: Column) -> Column:
    """A text without quoted lines, and without the attribution right before them."""
    lines = _lines(text)
    quoted = lambda x: F.coalesce(x.rlike(QUOTED), F.lit(False))
    return F.array_join(
        F.filter(lines, lambda x, i: ~quoted(x) & ~(x.rlike(ATTRIBUTION) & quoted(F.get(lines, i + 1)))), "\n"
    )


def _shingles(text: Column) -> Column:
    """Hashes of the distinct shingles of normalised words; none of fewer than five."""
    words = F.split(text, " ")
    each = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(each))


def _keys(messages: DataFrame) -> DataFrame:
    """(conv, key, turn): the first turn that has a paragraph or line as its own words."""
    own = F.col("_own")
    units = F.array_distinct(F.concat(F.split(own, r"\n\s*\n"), F.split(own, "\n"), F.array(own)))
    hashed = messages.select("_conv", "_turn", F.explode(units).alias("u")).select("_conv", "_turn", _normal(F.regexp_replace("u", "\n", " ")).alias("n"))
    return hashed.where("n <> ''").groupBy("_conv", F.sha2("n", 256).alias("_key")).agg(F.min("_turn").alias("_origin"))


def _passages(messages: DataFrame) -> DataFrame:
    """Quoted passages: message, number, level, lines and normalised text of each."""
    quoting = messages.where(F.col("_text").rlike(r"(?m)^\s*>")).dropDuplicates(["_row"])
    lines = quoting.select("_row", "_conv", "_turn", F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line")).withColumn("_level", _level(F.col("_line")))
    by = Window.partitionBy("_row").orderBy("_pos")
    runs = lines.withColumn("_new", (F.coalesce(F.lag("_level").over(by), F.lit(-1)) != F.col("_level")).cast("int"))
    runs = runs.withColumn("_no", F.sum("_new").over(by)).where("_level > 0").withColumn("_norm", _normal(F.col("_line")))
    return runs.groupBy("_row", "_conv", "_turn", "_no", "_level").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_norm"))), lambda s: s["_norm"]).alias("_norms")
    )


def _excerpts(messages: DataFrame, passages: DataFrame) -> DataFrame:
    """(row, no, origin) of passages whose shingles one earlier message has first, nearly all of them."""
    wanted = passages.select("_row", "_conv", "_turn", "_no", _shingles(F.col("_whole")).alias("_s")).where("_s is not null")
    each = wanted.select("_row", "_conv", "_turn", "_no", F.size("_s").alias("_n"), F.explode("_s").alias("_key"))
    there = messages.join(wanted.select("_conv").distinct(), "_conv", "left_semi")
    own = there.select("_conv", "_turn", F.explode(_shingles(_normal(F.regexp_replace("_own", "\n", " ")))).alias("_key"))
    first = own.groupBy("_conv", "_key").agg(F.min("_turn").alias("_origin"))
    votes = each.join(first, ["_conv", "_key"]).where("_origin < _turn").groupBy("_row", "_no", "_n", "_origin").agg(F.count("*").alias("_w"))
    best = votes.where(F.col("_w") >= CONTAINED * F.col("_n")).groupBy("_row", "_no").agg(F.max(F.struct("_w", (-F.col("_origin")).alias("o"))).alias("_b"))
    return best.select("_row", "_no", (-F.col("_b.o")).alias("_excerpt"))


def quotation_links(messages: DataFrame) -> DataFrame:
    """Of each message row with quotations: their number, how many link, and the parent turn."""
    passages = _passages(messages).withColumn("_text", F.regexp_replace(F.array_join("_norms", "\n"), r"^\n+|\n+$", ""))
    passages = passages.withColumn("_norms", F.filter("_norms", lambda x: x != "")).withColumn("_whole", F.array_join("_norms", " "))
    passages = checkpointed(passages)
    # a blank quoted line parts two paragraphs
    units = F.concat(
        F.array(F.struct(F.col("_whole").alias("n"), (F.size("_norms") + 1).alias("w"))),
        F.transform(F.split("_text", r"\n\n+"), lambda x: F.struct(F.replace(x, F.lit("\n"), F.lit(" ")).alias("n"), F.size(F.split(x, r"\n")).alias("w"))),
        F.transform("_norms", lambda x: F.struct(x.alias("n"), F.lit(1).alias("w"))),
    )
    keyed = passages.select("_row", "_conv", "_turn", "_no", "_level", F.explode(units).alias("_u"))
    keyed = keyed.select("_row", "_conv", "_turn", "_no", "_level", F.sha2("_u.n", 256).alias("_key"), F.col("_u.w").alias("_w"))
    found = keyed.join(_keys(messages), ["_conv", "_key"], "left").withColumn("_origin", F.when(F.col("_origin") < F.col("_turn"), F.col("_origin")))
    votes = found.groupBy("_row", "_no", "_level", "_origin").agg(F.sum("_w").alias("_w"))
    # most of the passage; of equals the earlier message; nothing only if nothing is found
    best = votes.groupBy("_row", "_no", "_level").agg(F.max(F.when(F.col("_origin").isNotNull(), F.struct("_w", (-F.col("_origin")).alias("o")))).alias("_b"))
    linked = checkpointed(best.select("_row", "_no", "_level", (-F.col("_b.o")).alias("_origin")))
    rest = passages.join(linked.where("_origin is null").select("_row", "_no"), ["_row", "_no"], "left_semi")
    linked = linked.join(_excerpts(messages, rest), ["_row", "_no"], "left").withColumn("_origin", F.coalesce("_origin", "_excerpt"))
    return linked.groupBy("_row").agg(
        F.count("*").alias("n_quotes"), F.count("_origin").alias("n_linked"),
        F.min(F.when(F.col("_origin").isNotNull(), F.struct("_level", "_no", "_origin"))).alias("_p"),
    ).select("_row", "n_quotes", "n_linked", F.col("_p._origin").alias("parent_turn"))


def _roots(edges: DataFrame) -> DataFrame:
    """(conv, turn) with a parent to its root and depth, by doubling; parents are always earlier."""
    now = checkpointed(edges.select("_conv", "_turn", F.col("_parent").alias("_root"), F.lit(1).cast("long").alias("_depth")))
    for _ in range(ROUNDS):
        up = now.select(F.col("_conv").alias("c"), F.col("_turn").alias("t"), F.col("_root").alias("r"), F.col("_depth").alias("d"))
        step = now.join(up, (F.col("_conv") == F.col("c")) & (F.col("_root") == F.col("t")), "left")
        if not step.where(F.col("r").isNotNull()).limit(1).count():
            return now
        now = checkpointed(step.select("_conv", "_turn", F.coalesce("r", "_root").alias("_root"), (F.col("_depth") + F.coalesce("d", F.lit(0))).alias("_depth")))
    return now


def link_quotations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input row: conversation, turn, role, the text without quotations and its links.

    Columns: n_quotes (passages), n_linked, parent_turn (null: no linked quotation), root_turn and depth
    (0 for a message without parent), and formatted: the role's marker and the text.  Ordered by
    conversation, root_turn, depth and turn the rows are the reply-ordered conversations.

    A null text is empty, a null role ``unknown``.  Rows with a null conversation or turn link to
    nothing.  Rows that repeat a conversation and turn are one message in links: the parent is the
    smallest of theirs.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a row is named by its values, which every evaluation of the input gives alike; repeated rows share a name
    row = F.sha2(F.to_json(F.struct(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x"))), 256)
    messages = conversations.select(
        row.alias("_row"), F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("_role"), text.alias("_text"),
    ).withColumn("_own", unquoted(F.col("_text")))
    links = checkpointed(quotation_links(messages))
    rows = messages.join(links, "_row", "left")
    # only replies: the rest are roots themselves
    replies = messages.select("_row", "_conv", "_turn").dropDuplicates(["_row"]).join(links.where("parent_turn is not null"), "_row")
    roots = _roots(replies.groupBy("_conv", "_turn").agg(F.min("parent_turn").alias("_parent")))
    named = roots.select(F.col("_conv").alias("c"), F.col("_turn").alias("t"), "_root", "_depth")
    out = rows.join(named, (F.col("_conv") == F.col("c")) & (F.col("_turn") == F.col("t")), "left")
    return out.select(
        F.col("_conv").alias(conv_col), F.col("_turn").alias(turn_col), F.col("_role").alias(role_col), F.col("_own").alias("text"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn", F.coalesce("_root", "_turn").alias("root_turn"), F.coalesce("_depth", F.lit(0)).cast("long").alias("depth"),
        F.concat(F.lit("<|"), "_role", F.lit("|>\n"), "_own").alias("formatted"),
    )
