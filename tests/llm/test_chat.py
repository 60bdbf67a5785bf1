import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import chat
from quern.llm.chat import conversations, link_passages, op8_quotation_links, op8_quoted_replies, own_text, reply_tree, segments, words_of

from quern.llm.chat_sql import OP8_SQL, REPLIES_SQL

from .helpers import rows_of

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "turn", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth", "position", "n_quoted", "n_linked", "text")


def build(spark, rows, parts=3, schema=SCHEMA):
    return rows_of(conversations(spark.createDataFrame(rows, schema).repartition(parts)), *COLUMNS)


def test_nested_quotes_attribution_and_forwards(spark):
    rows = [
        (1, 0, "a", "Hello there everyone\nHow are you all doing today?"),
        (1, 1, "b", "On Monday, Bob wrote:\n\n> How  are you all doing TODAY?\n\nI am fine thanks a lot"),
        (1, 2, "a", "> > How are you all doing today?\n>I am fine thanks a lot\nGood to hear that"),
        (2, 0, "c", ">> Hello there everyone\nforwarded"),
        (2, 1, "c", "no quotes > here"),
        (3, 5, "d", "> an unknown quoted line stands here\nreply"),
    ]
    assert build(spark, rows) == sorted(
        [
            (1, 0, None, None, 1, 0, 0, 0, 0, 0, rows[0][3]),
            (1, 1, 1, 0, 1, 0, 1, 1, 1, 1, "I am fine thanks a lot"),
            (2, 0, 1, 0, 1, 0, 1, 2, 1, 1, "forwarded"),
            (1, 2, 1, 1, 1, 0, 2, 3, 2, 2, "Good to hear that"),
            (2, 1, None, None, 2, 1, 0, 0, 0, 0, "no quotes > here"),
            (3, 5, None, None, 3, 5, 0, 0, 1, 0, "reply"),
        ],
        key=repr,
    )


def test_passages_link_however_they_are_wrapped_or_cut(spark):
    told = "The first sentence says this much. The meeting was moved to noon on friday because of the rain, and lunch is at one."
    rows = [
        (1, 0, "a", told),
        (1, 1, "b", "> The meeting was moved to noon\n> on friday because of the\n> rain,\nok"),
        (1, 2, "c", "> moved to noon on friday\ngood"),
        (1, 3, "c", ">The first sentence says this much. The meeting was moved ... lunch is at one\ngood"),
        (2, 0, "d", "> meeting was moved to noon on monday because of snow and wind and ice\nother words, one run of five alone"),
        (3, 0, "e", "Yes, do."),
        (3, 1, "e", "> yes do\nshort ones link in their conversation"),
        (4, 0, "e", "> yes do\nand not out of it"),
        (5, 0, "e", "会議は正午に移動しました。"),
        (5, 1, "e", "> 正午に移動\n> しました\n了解"),
    ]
    got = {(r[0], r[1]): r[2:4] + r[8:10] for r in build(spark, rows)}
    assert got[1, 1] == got[1, 2] == got[1, 3] == (1, 0, 1, 1)
    assert got[2, 0] == (None, None, 1, 0) and got[3, 1] == (3, 0, 1, 1) and got[4, 0] == (None, None, 1, 0) and got[5, 1] == (5, 0, 1, 1)


def test_sources_null_conversations_and_circles(spark):
    line = "the meeting is moved to friday noon"
    only = "only the nameless conversation says this"
    rows = [
        (5, 0, "a", f"> {line}\n{line}"),
        (5, 1, "a", f"and again\n{line}"),
        (7, 0, "b", line),
        (8, 0, "c", f"> {line}\nagreed"),
        (None, 0, "d", f"> {line}\n\n> {only}\nfine"),
        (None, 1, "d", only),
        (9, 0, "e", f"> {only}\nyes"),
        (None, 2, "d", f"> {only}\nme too"),
    ]
    got = {(r[0], r[1]): r[2:6] for r in build(spark, rows)}
    assert got[5, 0] == (7, 0, 7, 0) and got[8, 0] == (5, 1, 5, 1)
    # the null conv_id is one conversation, the last of all: it links and is linked to, but goes before none
    assert got[None, 0] == (5, 1, 5, 1) and got[9, 0] == (None, 1, None, 1) and got[None, 2] == (None, 1, None, 1)
    assert got[5, 1] == (None, None, 5, 1) and got[7, 0] == (None, None, 7, 0)
    # two that quote each other, and a third that quotes the first: the least replies to none
    rows = [(1, 0, "a", "> beta beta says the second one\nalpha alpha says the first one"), (2, 0, "b", "> alpha alpha says the first one\nbeta beta says the second one"), (3, 0, "c", "> alpha alpha says the first one\nme too")]
    got = {(r[0], r[1]): r[2:8] for r in build(spark, rows)}
    assert got == {(1, 0): (None, None, 1, 0, 0, 0), (2, 0): (1, 0, 1, 0, 1, 1), (3, 0): (1, 0, 1, 0, 1, 2)}


def test_trees_with_circles_and_long_chains(spark):
    links = [(c, t, c, t - 1) for c in (1, 2) for t in range(1, 40)]
    links += [(1, 0, 2, 39), (2, 0, 1, 20)]  # a circle through both, tails on it
    links += [(None, 5, None, 4), (None, 4, 9, 1), (9, 1, None, 5), (3, 1, 3, 0)]
    want = {}
    parent = {(c, t): (pc, pt) for c, t, pc, pt in links}
    parent.pop((1, 0))
    parent.pop((9, 1))
    for x in parent:
        root, depth = x, 0
        while root in parent:
            root, depth = parent[root], depth + 1
        want[x] = (*root, depth)
    tree = reply_tree(spark.createDataFrame(links, "conv_id long, turn long, parent_conv long, parent_turn long").repartition(5))
    assert {(r[0], r[1]): tuple(r[2:]) for r in tree.collect()} == want


# ---------------------------------------------------------------- the rule message by message


def brute_windows(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_segments(text):
    runs = []
    for line in text.split("\n"):
        marks = re.match(r"[ \t>]*", line)[0]
        level = marks.count(">")
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(line[len(marks) :] if level else line)
    return runs


def brute(rows):
    """Unique (conv, turn) without null turns; None sorts last."""
    last = lambda m: (m[0] is None, m)
    own, quoted = {}, {}
    for c, t, _, text in rows:
        held, passages = set(), []
        for level, lines in brute_segments(text):
            words = [w for x in lines for w in words_of(x)]
            if level and words:
                passages.append((level, brute_windows(words), len(words) < 5 and len(" ".join(words)) < 10))
            elif words:
                held |= brute_windows(words)
                held |= {tuple(words_of(x)) for line in lines for x in [line, *re.split(r"[.!?;:…]+\s+", line)] if 0 < len(words_of(x)) < 5}
        own[c, t], quoted[c, t] = held, passages
    parents, stats = {}, {}
    for m, passages in quoted.items():
        votes, linked = {}, 0
        for level, windows, near in passages:
            to = {}
            for w in windows:
                holders = [x for x in own if w in own[x]]
                here = min((x for x in holders if x[0] == m[0]), key=last, default=None)
                by_conv = {}
                for x in holders:
                    if x[0] != m[0]:
                        mine = any(w in p[1] for p in quoted[x])
                        by_conv.setdefault(x[0], []).append((mine, x[1]))
                # a conversation's source is its earliest message that doesn't quote the window
                far = [(not any(not q for q, _ in v), c is None, c, min(t for q, t in v if not q) if any(not q for q, _ in v) else min(t for _, t in v)) for c, v in by_conv.items()]
                far = min(far, default=None, key=lambda x: x[:2] + (x[2] or 0, x[3]))
                if here and here[1] < m[1]:
                    to[here] = to.get(here, 0) + 1
                elif far and not near:
                    to[far[2:]] = to.get(far[2:], 0) + 1
            order = lambda x: (x[0] != m[0], x[0] is None, x[0] or 0, x[1])
            best = min(to, key=lambda x: (-to[x], order(x)), default=None)
            if best and 2 * to[best] >= len(windows):
                linked += 1
                votes[level, best] = votes.get((level, best), 0) + to[best]
        if passages:
            stats[m] = (len(passages), linked)
        if votes:
            parents[m] = min(votes, key=lambda x: (x[0], -votes[x], order(x[1])))[1]
    for m in sorted(parents, key=last):  # circles lose the link of their least message
        seen, x = [m], parents[m]
        while x in parents and x not in seen:
            seen.append(x)
            x = parents[x]
        if x in seen:
            parents.pop(min(seen[seen.index(x) :], key=last))
    out = []
    for m in own:
        root, depth = m, 0
        while root in parents:
            root, depth = parents[root], depth + 1
        out.append((*m, *parents.get(m, (None, None)), *root, depth, *stats.get(m, (0, 0))))
    place = {}
    for r in sorted(out, key=lambda r: (r[5], r[6], last(r[:2]))):
        place[r[:2]] = sum(1 for x in place if next(o[4] for o in out if o[:2] == x) == r[4])
    return sorted((*r[:7], place[r[:2]], *r[7:]) for r in out) if all(r[0] is not None for r in out) else sorted(((*r[:7], place[r[:2]], *r[7:]) for r in out), key=repr)


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_random_threads_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    phrases = [f"{rng.choice(['red', 'blue', 'green'])} sentence number {i} of the talk. {rng.choice(['Then', 'So'])} it is" for i in range(14)]
    rows = []
    for c in [0, 1, 2, None]:
        for t in range(8):
            own = [rng.choice(phrases) for _ in range(rng.randint(1, 2))]
            # quotes lead anywhere, so there are circles and ties
            quotes = []
            for _ in range(rng.randint(0, 2)):
                words = " ".join(rng.sample(phrases, rng.randint(1, 2))).split()
                cut = rng.randint(0, 3)
                mark = "> " * rng.randint(1, 2)
                at = rng.randint(2, len(words) - 1)
                quotes += [mark + " ".join(words[cut:at]), mark + " ".join(words[max(cut, at) :])]
            rows.append((c, t, "user", "\n".join(quotes + own)))
    want = sorted(brute(rows), key=repr)
    assert any(r[2] is not None and r[0] != r[2] for r in want) and any(r[6] > 1 for r in want)
    for parts in (1, 4, 7):
        assert [r[:10] for r in build(spark, rows, parts)] == want


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP8_SQL})").fetchall(), key=repr)


def test_sql_equals_operator(spark):
    rng = random.Random(11)
    line, only = "the meeting is moved to friday noon", "only the nameless conversation says this"
    rows = [
        (1, 0, "a", "Hello there everyone\nHow are you all doing today? Yes, do."),
        (1, 1, "b", "On Monday, Bob wrote:\r\n\r\n> How  are you all\r\n> doing TODAY?\n\nI am fine thanks a lot\n> > older words that nobody here has said"),
        (1, 2, "a", "> > How are you all doing today?\n>I am fine thanks a lot\nGood to hear that\n>yes do"),
        (2, 0, "c", ">> Hello there everyone\nforwarded:\n"),
        (5, 0, "a", f"> {line}\n{line}"),
        (5, 1, "a", f"and again\n{line}"),
        (7, 0, "b", line),
        (8, 0, "c", f"> {line}\nagreed"),
        (None, 0, "d", f"> {line}\n\n> {only}\nfine"),
        (None, 1, "d", only),
        (9, 0, "e", f"> {only}\nyes"),
        (20, 0, "e", "会議は正午に移動しました。ab 東京cd"),
        (20, 1, "e", "> 正午に移動\n> しました\n了解"),
        (30, 0, "a", "> beta beta says the second one\nalpha alpha says the first one"),
        (31, 0, "b", "> alpha alpha says the first one\nbeta beta says the second one"),
        (32, 0, "c", "> alpha alpha says the first one\nme too"),
        (33, None, "c", "> alpha alpha says the first one\nand me"),
        (34, 0, None, None),
    ]
    rows += [(100 + i, t, "u", " ".join(rng.choice("red green blue > old\n new. so".split(" ")) for _ in range(30))) for i in range(6) for t in range(4)]
    assert by_sql(rows) == build(spark, rows)


def test_a_third_of_all_messages_in_one_thread(spark):
    rows = [(0, 0, "a", "everyone will quote these words of mine")] + [(i, 1, "b", "> everyone will quote these words of mine\nyes") for i in range(1, 200)] + [(0, 2, "b", None)] * 200
    got = build(spark, rows, 8)
    assert sorted(r[7] for r in got if r[4] == 0) == list(range(400))
    assert all(r[2:6] == (0, 0, 0, 0) for r in got if r[0])


def test_awkward_messages(spark):
    rows = [(None, 0, "user", "x"), (None, None, None, None), (1, None, "u", ""), (1, 1, "u", None), (1, 1, "u", "same turn"), (1, 1, "u", "same turn"), (2, 0, "u", "> " * 20_000 + "deep quotation of nothing"), (2, 1, "u", "word " * 40_000), (1, None, "u", "> same turn\nx"), (2, 2, "u", "> " + "word " * 1000)]
    clash = "print long, passage int, level int, h1 long, depth long, position long, c0 string, root_conv long, n long"
    got = build(spark, [(*r, *[None] * 9) for r in rows], schema=f"{SCHEMA}, {clash}")
    assert len(got) == len(rows)
    assert sorted(r[7] for r in got if r[0] == 1) == [0, 1, 2, 3, 4]
    assert next(r for r in got if r[:2] == (2, 2))[2:10] == (2, 1, 2, 1, 1, 2, 1, 1)
    assert build(spark, rows[:0]) == []


def test_parts_of_a_message():
    text = "Hi,\r\nOn May 3, A. B. wrote:\r\n\r\n> > older\r\n> newer\r\n>\r\n> more\r\nmine"
    assert segments(text) == [(0, ["Hi,", ""]), (2, ["older"]), (1, ["newer", "", "more"]), (0, ["mine"])]
    assert own_text(text) == "Hi,\n\nmine" and own_text("a\r\nb") == "a\r\nb"
    assert segments("> " + "On " + "x" * 5000 + " wrote:\n>> y")[0] == (2, ["y"])


SHARED = [
    (1, 0, "a", "the very first words of this whole thread"),
    (1, 1, "b", "> the very first words of this whole thread\nan answer that is quoted further on"),
    (2, 1, "a", "> the very first words of this whole thread\none of two that share a turn"),
    (2, 1, "b", "another one which quotes nothing at all"),
    (2, 1, "c", "> an answer that is quoted further on\na third one which quotes a reply"),
    (3, 0, "d", "> another one which quotes nothing at all\nas I said"),
]


def test_messages_that_share_a_turn_have_their_own_parents(spark):
    got = {(r[0], r[1], r[10][:7]): r[2:7] + r[8:10] for r in build(spark, SHARED)}
    assert got[2, 1, "one of "] == (1, 0, 1, 0, 1, 1, 1)
    assert got[2, 1, "another"] == (None, None, 2, 1, 0, 0, 0)
    assert got[2, 1, "a third"] == (1, 1, 1, 0, 2, 1, 1)
    # who quotes the turn stands below what its messages reply to, together
    assert got[3, 0, "as I sa"] == (2, 1, 1, 0, 2, 1, 1)
    assert by_sql(SHARED) == build(spark, SHARED)


def test_query_links_its_replies_and_keeps_all_messages(spark, sf_dir):
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert link_passages(messages).count() == 0  # the given ones quote nothing
    plain = op8_quotation_links(spark, sf_dir)
    assert rows_of(plain, "conv_id", "turn", "role") == rows_of(messages, "conv_id", "turn", "role") and plain.where("n_quoted > 0").count() == 0
    found = op8_quoted_replies(spark, sf_dir)
    assert rows_of(found.where("role <> 'reply'"), "conv_id", "turn", "role") == rows_of(messages, "conv_id", "turn", "role")
    replies = found.where("role = 'reply'").collect()
    assert len(replies) > 10 and all(r.n_quoted == 1 and r.text == "Thank you, noted." for r in replies)
    assert sum(r.n_linked for r in replies) > 0.8 * len(replies)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    columns = [*COLUMNS, "role"]
    assert sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({REPLIES_SQL})").fetchall(), key=repr) == rows_of(found, *columns)
