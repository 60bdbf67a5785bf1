"""Chat formatting: quoted passages are linked to the messages that they quote, and left out of the conversation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import byte_blocks, drop_stash, may_hold, ranked, stash, table

#: Words of a window. A shorter passage is one window, and so are an author's own lines, sentences and paragraphs that are shorter.
WORDS = 5
#: A passage of fewer words than a window and fewer characters than this links inside its conversation alone.
MIN_CHARS = 10
#: A passage quotes a message if it shares this part of its windows with it: 1 / SHARE.
SHARE = 2
#: Bytes of text that are parsed at once.
BLOCK_BYTES = 1 << 20

_MARKS = re.compile(r"[ \t>]*")
#: An attribution line before a quotation, like "On Monday, A. wrote:".
_ATTRIBUTION = re.compile(r"(?i)[ \t]*(?:on .+ wrote|am .+ schrieb .+|le .+ a écrit|el .+ escribió)[ \t]*:[ \t]*")
_SENTENCE_END = re.compile(r"[.!?;:…]+\s+|[。！？]")
#: Letters and digits; in scripts that set no blanks between words, each character is one.
_NO_BLANKS = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿"
_WORD = re.compile(rf"[{_NO_BLANKS}]|[^\W_{_NO_BLANKS}]+")
#: Odd factors of the places in a window, for two hashes (any fixed numbers do).
_FACTORS = np.random.default_rng(5).integers(1 << 62, 1 << 63, (2, WORDS), np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def segments(text: str) -> list[tuple[int, list[str]]]:
    """(level, lines) of the runs of lines that share a quote level, marks off; level 0 is the author's own.

    The level is the number of marks `>` at the line's start. Attributions, lines like "A. wrote:" whose next line
    that isn't blank is quoted deeper, belong to no segment.
    """
    rows = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        marks = _MARKS.match(line)[0]
        level = marks.count(">")
        rows.append((level, line[len(marks) :] if level else line))
    deeper = 0
    kept = []
    for level, line in reversed(rows):
        if not (deeper > level and line.rstrip().endswith(":") and _ATTRIBUTION.fullmatch(line)):
            kept.append((level, line))
        if line.strip():
            deeper = level
    return [(level, [line for _, line in run]) for level, run in groupby(reversed(kept), key=lambda x: x[0])]


def own_text(text: str) -> str:
    """The text without quoted lines and the attributions before them; as it is if it has no mark."""
    if ">" not in text:
        return text
    return "\n".join(line for level, lines in segments(text) if not level for line in lines).strip("\n")


def _hashed(words: list[str]) -> np.ndarray:
    """(windows, 2): the hashes of all windows of WORDS words, or of all words if they are fewer."""
    codes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    codes = np.stack([codes, codes ^ (codes >> np.uint64(29))], 1)
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    total = np.full((n, 2), k, np.uint64)
    for i in range(k):
        total = (total + codes[i : i + n]) * _FACTORS[:, i]
        total ^= total >> np.uint64(31)
    return total


def passage_windows(lines: list[str]) -> tuple[np.ndarray, bool]:
    """The distinct windows of a quoted passage, and whether it is so short that it links inside its conversation alone."""
    words = [w for line in lines for w in words_of(line)]
    if not words:
        return np.zeros((0, 2), np.uint64), True
    return np.unique(_hashed(words), axis=0), len(words) < WORDS and len(" ".join(words)) < MIN_CHARS


def own_windows(text: str) -> np.ndarray:
    """The distinct windows of the author's own words: of each segment, and its shorter lines and sentences whole."""
    found = [np.zeros((0, 2), np.uint64)]
    for level, lines in segments(text) if ">" in text else [(0, re.split("\r\n?|\n", text))]:
        if level:
            continue
        every: list[str] = []
        for line in lines:
            sentences = [words_of(s) for s in _SENTENCE_END.split(line)]
            held = [w for s in sentences for w in s]
            every += held
            found += [_hashed(s) for s in [held, *sentences] if 0 < len(s) < WORDS]
        if every:
            found.append(_hashed(every))
    return np.unique(np.concatenate(found), axis=0)


def _column(hashes: np.ndarray, k: int) -> pa.Array:
    return pa.array(np.ascontiguousarray(hashes[:, k]).view(np.int64))


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in byte_blocks(batches, "text", BLOCK_BYTES):
        row, passage, level, size, near, hashes = [], [], [], [], [], [np.zeros((0, 2), np.uint64)]
        for i, text in enumerate(block.column("text").to_pylist()):
            for p, (depth, lines) in enumerate(segments(text)):
                found, short = passage_windows(lines) if depth else ((), True)
                n = len(found)
                if n:
                    row += [i] * n
                    passage += [p] * n
                    level += [depth] * n
                    size += [n] * n
                    near += [short] * n
                    hashes.append(found)
        every = np.concatenate(hashes)
        columns = [*block.drop_columns(["text"]).take(pa.array(row, pa.int32())).columns, pa.array(passage, pa.int32()), pa.array(level, pa.int32()), pa.array(size, pa.int32()), pa.array(near, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*columns, _column(every, 0), _column(every, 1)], names=["conv_id", "turn", "print", "passage", "level", "size", "near", "h1", "h2"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in byte_blocks(batches, "text", BLOCK_BYTES):
        found = [own_windows(text) for text in block.column("text").to_pylist()]
        row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        every = np.concatenate([np.zeros((0, 2), np.uint64), *found])
        yield pa.RecordBatch.from_arrays([*block.drop_columns(["text"]).take(pa.array(row)).columns, _column(every, 0), _column(every, 1)], names=["conv_id", "turn", "h1", "h2"])


def _bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array([own_text(t) for t in batch.column("text").to_pylist()], pa.string()))


HASH = ("h1", "h2")
PASSAGE = ("conv_id", "turn", "print", "passage", "level", "size")


def _fields(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def link_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, print, passage, level, size, n, to) of every quoted passage: its message and that one's text hash,
    its number and quote level, its number of windows, and the message it quotes, if any, with the windows they share.

    A passage is a run of lines of one quote level. Its words, lower case, without marks, line breaks and punctuation, are
    hashed (128 bits) by windows of WORDS words, and joined to the same windows of the authors' own words: however a
    quotation is wrapped, and if it is only a part of its original, its windows are the original's. A window leads to
    the earliest message of its conversation that holds it, if that stands before the quoting one; else to the first
    of another conversation, one that doesn't quote the window itself if there is one. The passage quotes the message that
    most of its windows lead to, if they are at least 1 / SHARE of them; ties go to its own conversation, then to the
    least (conv_id, turn).

    Only windows that somebody quotes are indexed: a bitmap of fixed size drops most others where they are read. The index
    has one row for each window and conversation, and two conversations for each window over all, so a passage that
    very many messages share links as cheaply as any other, and no pairs are emitted.

    The null conv_id is a conversation, the last of all. Messages with a null turn cannot be told from others of theirs,
    so they quote, but are not quoted; messages that share conv_id and turn are quoted as one.
    """
    held = messages.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    keys = _fields(held, "conv_id", "turn")
    quoting = held.where(F.col("text").contains(">")).select("conv_id", "turn", F.xxhash64("text").alias("print"), "text")
    quoted = quoting.mapInArrow(_quoted, f"{keys}, print long, passage int, level int, size int, near boolean, h1 long, h2 long").distinct()
    quoted = stash(quoted, "quoted-windows")
    wanted = quoted.select(*HASH).distinct()
    own = may_hold(held.where("turn is not null").mapInArrow(_held, f"{keys}, h1 long, h2 long"), quoted, HASH).where("__may").drop("__may")
    # a holder that quotes the window too is no source of it
    quoters = quoted.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("h1").alias("k1"), F.col("h2").alias("k2")).distinct()
    own = own.join(wanted, list(HASH), "left_semi").join(quoters, F.expr("conv_id <=> c and turn = t and h1 = k1 and h2 = k2"), "left")
    source = F.min(F.when(F.col("k1").isNull(), F.col("turn"))).alias("source_turn")
    index = stash(own.groupBy("conv_id", *HASH).agg(F.min("turn").alias("near_turn"), source), "window-index")
    by = Window.partitionBy(*HASH).orderBy(F.col("source_turn").isNull(), F.asc_nulls_last("conv_id"))
    top = index.withColumn("rank", F.row_number().over(by)).where("rank <= 2")
    holder = F.struct("conv_id", F.coalesce("source_turn", "near_turn").alias("turn"))
    at = lambda k: F.max(F.when(F.col("rank") == k, holder)).alias(f"first{k}")
    first = stash(top.groupBy(*HASH).agg(at(1), at(2)), "first-holders")
    near = index.select(F.col("conv_id").alias("c"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "near_turn")
    found = quoted.join(near, F.expr("conv_id <=> c and h1 = k1 and h2 = k2"), "left").drop("c", "k1", "k2").join(first, list(HASH), "left")
    to = F.when(F.col("near_turn") < F.col("turn"), F.struct("conv_id", F.col("near_turn").alias("turn")))
    for c in ("first1", "first2"):
        to = to.when(~F.col("near") & F.col(c).isNotNull() & ~F.col(f"{c}.conv_id").eqNullSafe(F.col("conv_id")), F.col(c))
    votes = found.withColumn("to", to).groupBy(*PASSAGE, "to").agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("to").isNotNull(), F.col("n"))
    best = votes.groupBy(*PASSAGE).agg(F.max(n).alias("n"), F.min_by("to", F.when(F.col("to").isNotNull(), F.struct(-F.col("n"), *_after()))).alias("to"))
    enough = F.col("n") * SHARE >= F.col("size")
    return best.select(*PASSAGE, F.when(enough, F.col("n")).alias("n"), F.when(enough, F.col("to")).alias("to"))


def _after() -> list[Column]:
    """The order of messages to quote: one's own conversation first, then (conv_id, turn), the null conv_id last."""
    return [(~F.col("to.conv_id").eqNullSafe(F.col("conv_id"))).alias("far"), F.col("to.conv_id").isNull().alias("no_conv"), F.col("to.conv_id"), F.col("to.turn")]


def _parents(passages: DataFrame, *of: str) -> DataFrame:
    """(of..., to): the message that those of one `of` reply to, by the linked passages of theirs: of the least quote level
    with a link, the one with most windows."""
    votes = passages.where("to is not null").groupBy("conv_id", *of, "level", "to").agg(F.sum("n").alias("n"))
    return votes.groupBy("conv_id", *of).agg(F.min_by("to", F.struct("level", -F.col("n"), *_after())).alias("to"))


def link_quotes(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, print, n_quoted, n_linked, parent_conv, parent_turn) of the messages that quote: their passages, those
    that are linked, and the message they reply to. And (conv_id, turn, parent_conv, parent_turn) of the turns that
    quote: messages that share a turn are quoted as one, so what is above a quoted turn follows from all of them."""
    passages = stash(link_passages(messages), "passages")
    sums = passages.groupBy("conv_id", "turn", "print").agg(F.count(F.lit(1)).alias("n_quoted"), F.count("to").alias("n_linked"))
    parents = _parents(passages, "turn", "print").toDF("c", "t", "p", "to")
    both = sums.join(parents, F.expr("conv_id <=> c and turn <=> t and print = p"), "left")
    to = [F.col("to.conv_id").alias("parent_conv"), F.col("to.turn").alias("parent_turn")]
    return both.select("conv_id", "turn", "print", "n_quoted", "n_linked", *to), _parents(passages, "turn").select("conv_id", "turn", *to)


def reply_tree(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of the messages that reply: the message that their chain of parents leads
    to, and their distance from it; links: (conv_id, turn, parent_conv, parent_turn).

    By pointer doubling, so rounds grow with the logarithm of the longest chain. Messages that quote each other in a
    circle are a tree too: its least message, by conv_id and turn, null last, replies to none.
    """
    no_conv = lambda c, t: F.struct(F.col(c).isNull().alias("no_conv"), F.col(c).alias("conv"), F.col(t).alias("turn"))
    links = stash(links.select("conv_id", "turn", "parent_conv", "parent_turn"), "replies")
    up = links.select("conv_id", "turn", F.col("parent_conv").alias("root_conv"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"), no_conv("conv_id", "turn").alias("least"))
    names, n, reach, open_ = up.columns, links.count(), 1, True
    while open_ and reach < n:
        above = up.toDF("c", "t", "far_conv", "far_turn", "far_depth", "far_least")
        moved = F.col("t").isNotNull()
        step = up.join(above, F.expr("root_conv <=> c and root_turn = t"), "left")
        step = step.select(
            "conv_id",
            "turn",
            F.when(moved, F.col("far_conv")).otherwise(F.col("root_conv")).alias("root_conv"),
            F.when(moved, F.col("far_turn")).otherwise(F.col("root_turn")).alias("root_turn"),
            (F.col("depth") + F.coalesce("far_depth", F.lit(0))).alias("depth"),
            F.when(moved, F.least("least", "far_least")).otherwise(F.col("least")).alias("least"),
            moved.alias("moved"),
        )
        after = stash(step, "replies")
        if reach > 1:
            drop_stash(up)
        open_, reach, up = bool(after.where("moved").head(1)), reach * 2, after.drop("moved")
    # no chain is longer than n: one that still leads to a message with a parent goes round a circle, and where it has come is on it
    nodes = up.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("least").alias("far_least"))
    on_circle = up.join(nodes, F.expr("root_conv <=> c and root_turn = t"), "left")
    circles = stash(on_circle.select(*names, F.col("t").isNotNull().alias("round"), "far_least"), "circles")
    done = circles.where("not round").select(*names[:5])
    if not circles.where("round").head(1):
        return done
    cut = circles.where("round").select("far_least").distinct().select(F.col("far_least.conv").alias("c"), F.col("far_least.turn").alias("t"))
    left = circles.where("round").select("conv_id", "turn").join(cut, F.expr("conv_id <=> c and turn = t"), "left_anti").toDF("c", "t")
    return done.unionByName(reply_tree(links.join(left, F.expr("conv_id <=> c and turn = t"), "left_semi")))


def conversations(messages: DataFrame) -> DataFrame:
    """A row for each message: its place in its conversation, its parent and thread, and its text without quotes.

    Messages that reply by quoting move to the conversation of their thread's root, the message that quotes no other.
    A conversation is ordered by its threads' first turns, and a thread by replies: a message stands after the one it
    quotes, by its depth in the reply tree, then by (conv_id, turn). Without quotes that is the order of turns. position
    counts from 0. Conversations are ranked by ranges of this order, so one that holds a third of all messages, or of all
    equal turns, is no single task's work.

    Null text is empty. Null conv_id is a conversation, the last among others; a null turn stands first and quotes, but
    is in no thread but its own. Messages that share a turn keep a row each, ordered by role and a hash of their text, and
    each has the links of its own text alone; who quotes such a turn stands below what all of them reply to. An empty
    table gives no rows; other columns don't matter.
    """
    messages = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    links, turns = link_quotes(messages)
    tree = stash(reply_tree(turns.where("parent_turn is not null and turn is not null")), "trees")
    # a message of a turn that still replies has its own parent, and what is above that one above itself
    replying = tree.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.lit(True).alias("replies"))
    above = tree.toDF("above_conv", "above_turn", "far_conv", "far_turn", "far_depth")
    links = links.join(replying, F.expr("conv_id <=> c and turn <=> t"), "left").join(above, F.expr("parent_conv <=> above_conv and parent_turn = above_turn"), "left")
    replies, further = F.col("replies") & F.col("parent_turn").isNotNull(), F.col("far_turn").isNotNull()
    links = links.select(
        F.col("conv_id").alias("c"),
        F.col("turn").alias("t"),
        F.col("print").alias("p"),
        "n_quoted",
        "n_linked",
        F.coalesce(replies, F.lit(False)).alias("replies"),
        "parent_conv",
        "parent_turn",
        F.when(further, F.col("far_conv")).otherwise(F.col("parent_conv")).alias("root_conv"),
        F.when(further, F.col("far_turn")).otherwise(F.col("parent_turn")).alias("root_turn"),
        (F.coalesce("far_depth", F.lit(0)) + 1).alias("depth"),
    )
    links = stash(links, "threads")
    printed = messages.select("*", F.xxhash64("text").alias("print"))
    bare = printed.mapInArrow(_bare, _fields(printed, *printed.columns))
    named = bare.join(links, F.expr("conv_id <=> c and turn <=> t and print = p"), "left").withColumn("replies", F.coalesce("replies", F.lit(False)))
    placed = named.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("replies"), F.col("parent_conv")).alias("parent_conv"),
        F.when(F.col("replies"), F.col("parent_turn")).alias("parent_turn"),
        F.when(F.col("replies"), F.col("root_conv")).otherwise(F.col("conv_id")).alias("root_conv"),
        F.when(F.col("replies"), F.col("root_turn")).otherwise(F.col("turn")).alias("root_turn"),
        F.when(F.col("replies"), F.col("depth")).otherwise(0).cast("long").alias("depth"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "text",
    )
    order = ["root_turn", "depth", F.asc_nulls_last("conv_id"), "turn", "role", F.xxhash64("text")]
    return ranked(placed, ["root_conv"], order, "position", "conversations")


#: Every so many conversations get a reply that quotes each of their messages, at turns from REPLY_TURN on.
REPLY_EVERY, REPLY_TURN = 4, 1_000_000


def with_replies(messages: DataFrame) -> DataFrame:
    """The messages, and replies that quote those of every REPLY_EVERY-th conversation whole: the given conversations quote
    nothing, so a query over them alone links nothing."""
    quoting = messages.where((F.col("conv_id") % REPLY_EVERY == 0) & F.length(F.trim("text")).between(1, 1 << 20))
    text = F.concat(F.lit("On Monday, A. wrote:\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")), F.lit("\nThank you, noted."))
    replies = quoting.select("conv_id", (F.col("turn") + REPLY_TURN).alias("turn"), F.lit("reply").alias("role"), text.alias("text"))
    return messages.select("conv_id", "turn", "role", "text").unionByName(replies)


def op8_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


def op8_quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(with_replies(table(spark, sf_dir, "conversations")))
