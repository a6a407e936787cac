import random
import re

from strandloom.llm import quotes as Q


def plain(text):
    return " ".join(text.split()).casefold()


def split(text):
    """Own text, and the quoted passages as (level, text), for texts of quoted lines and own lines without blank ones."""
    own, passages = [], []
    last = 0
    for line in (text or "").split("\n"):
        marks = re.match(r"[ >]*", line)[0] if line.lstrip().startswith(">") else ""
        level, bare = marks.count(">"), line[len(marks) :]
        if not level:
            own.append(line)
        elif level == last:
            passages[-1][1] += "\n" + bare
        elif bare.strip():
            passages.append([level, bare])
        last = level
    return "\n".join(own).strip(), passages


def holds(own, passage):
    """Is the passage the text, or a run of its lines?"""
    lines, n = own.split("\n"), len(passage.split("\n"))
    return plain(passage) in {plain(own), *(plain(" ".join(lines[i : i + n])) for i in range(len(lines) - n + 1))}


def brute(rows):
    """(conv, turn) -> (own text, reply_to, links, place in reply order) straight from the definitions."""
    got = {(c, t): split(x) for c, t, x in rows}
    out, parents = {}, {}
    for (c, t), (own, passages) in got.items():
        links, answer = [], None
        for level, p in passages:
            have = [k for k, (o, _) in got.items() if o and holds(o, p)]
            here = [u for d, u in have if d == c and u < t]
            to = (c, max(here)) if here else min(have, default=None)
            if to and not (to[0] == c and to[1] >= t):
                links.append((level, *to))
                if level == 1 and to[0] == c:
                    answer = to[1]
        before = [u for d, u in got if d == c and u < t]
        parents[c, t] = answer if answer is not None else max(before, default=None)
        out[c, t] = [own, parents[c, t], links]
    for c in {c for c, _ in got}:
        order, todo = [], [min(t for d, t in got if d == c)]
        while todo:
            order.append(todo.pop())
            todo += sorted((t for (d, t), u in parents.items() if d == c and u == order[-1]), reverse=True)
        for i, t in enumerate(order):
            out[c, t].append(i)
    return out


def test_parse_levels():
    own, passages = Q.parse("Hi\n\nOn Monday, Ann wrote:\n> one\n> two\n>\n> > deep  er\n>> Still\nmy answer\n> last")
    assert own == "Hi\n\nmy answer"
    assert passages == [(1, Q.key_of(["ONE two"]), 2), (2, Q.key_of(["deep er still"]), 2), (1, Q.key_of(["last"]), 1)]
    assert Q.parse(None) == ("", []) and Q.parse("a > b") == ("a > b", [])


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Q, "SPAN", 4)
    rnd = random.Random(4)
    said = [f"Sentence {i} of\nsome  length {i}\nthat\ngoes on, {i}." for i in range(12)]
    rows = []
    for c in range(6):
        for t in range(rnd.randint(1, 60)):
            text = rnd.choice(said)
            for _ in range(rnd.randint(0, 2)):
                mark = rnd.choice(["> ", ">", ">> ", " > > "])
                text = "\n".join(mark + x for x in rnd.choice([rnd.choice(said), "never said", "Sentence 3 of", "\n".join(rnd.choice(said).split("\n")[rnd.randint(0, 1) : rnd.randint(2, 4)])]).upper().split("\n")) + "\n" + text
            rows.append((c, t * rnd.choice([1, 1, 3]) + c, text))
    rows = list({(c, t): (c, t, x) for c, t, x in rows}.values()) + [(50, 0, None), (50, 1, "> "), (51, 0, "x " * 50_000)]
    df = spark.createDataFrame([(c, t, "user", x, 0) for c, t, x in rows], "conv_id long, turn long, role string, text string, position int").repartition(4)
    got = Q.reply_order(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        own, reply, links, place = want[r.conv_id, r.turn]
        assert (r.text, r.reply_to, [tuple(q) for q in r.quoted], r.position, r.n_linked) == (own, reply, links, place, len(links))
    assert sum(r.n_linked for r in got) > 20
    assert any(r.position != sum(c == r.conv_id and t < r.turn for c, t, _ in rows) for r in got)  # links move rows


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, None, "user", "start"), (None, 3, None, "> a b\nyes"), (1, 2, "x", "> A  b\nok")]
    got = Q.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 5
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 2].reply_to == 0 and by[1, 2].position == 2 and by[None, 3].quoted[0][1:] == (1, 0) and by[1, None].reply_to is None
    assert Q.reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
