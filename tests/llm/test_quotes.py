import random
import re
from itertools import groupby

from fotolake.llm import quotes
from fotolake.llm.quotes import link_quotes

SCHEMA = "conv_id long, turn int, role string, text string, level string, block int"
ROWS = [
    (1, 0, "user", "Hello there\nfriend"),
    (1, 1, "assistant", "> Hello  there\nHi!\nSecond line"),
    (1, 2, "user", "On Monday A wrote:\n> hi!\n> second line\n>> hello there\n\nOk"),
    (1, 3, "user", "> unknown thing\nnothing"),
    (1, 4, "user", "> Hello there\n> friend\nlate reply"),
    (1, 5, "assistant", "go on"),
    (2, 0, "user", None),
    (None, 1, "user", "> x"),
    (3, None, "user", "no turn"),
    (3, 700, "u", "abc"),
    (3, 1500, "u", "> ABC\nyes"),
    (3, 1500, "u", "> ABC\nyes"),
    (4, 0, "u", "> quotes nothing"),
]


def linked(spark, rows):
    found = link_quotes(spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)).collect()
    return {(r["conv_id"], r["turn"]): r for r in found}, found


def test_links_levels_and_order(spark, monkeypatch):
    for block in (512, 2):  # as-of lookups do not depend on where blocks end
        monkeypatch.setattr(quotes, "BLOCK", block)
        by, found = linked(spark, ROWS)
        assert len(found) == len(ROWS) - 1  # equal rows are one message
        at = lambda c, t: tuple(by[c, t][x] for x in ("n_quoted", "n_linked", "deepest", "reply_to", "branch", "position"))
        assert at(1, 0) == (0, 0, 0, None, 0, 0)
        assert at(1, 1) == (1, 1, 1, 0, 0, 1)
        assert at(1, 2) == (2, 2, 2, 1, 0, 2)
        assert at(1, 3) == (1, 0, 1, 2, 0, 3)
        assert at(1, 4) == (1, 1, 1, 0, 4, 4)
        assert at(1, 5) == (0, 0, 0, 4, 4, 5)
        assert at(3, 1500) == (1, 1, 1, 700, 0, 1)
        assert by[1, 2]["text"].strip() == "Ok" and by[1, 1]["text"] == "Hi!\nSecond line"
        assert by[2, 0]["text"] == "" and by[4, 0]["text"] == ""
        assert by[None, 1]["position"] is None and by[3, None]["text"] == "no turn"


def test_a_reply_never_precedes_what_it_answers(spark):
    rows = [(7, 0, "u", "root text")]
    for t in range(1, 40):
        quoted = (t * 7) % t
        rows.append((7, t, "u", f"> text number {quoted}\ntext number {t}" if t % 3 == 0 and quoted else f"text number {t}"))
    by, found = linked(spark, rows)
    assert sorted(r["position"] for r in found) == list(range(40))
    for r in found:
        if r["reply_to"] is not None:
            assert by[7, r["reply_to"]]["position"] < r["position"]


def test_without_quotes_and_without_rows(spark):
    by, _ = linked(spark, [(1, t, "u", "same words") for t in range(5)])
    assert [by[1, t]["reply_to"] for t in range(5)] == [None, 0, 1, 2, 3]
    assert link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


def brute(rows):
    """(conv_id, turn): n_quoted, n_linked, deepest, reply_to, branch, position, from plain loops."""
    sign = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t.lower()).strip(" ")
    out, by_conv = {}, {}
    for c, t, _, text in rows:
        by_conv.setdefault(c, {})[t] = text
    for c, told in by_conv.items():
        offers, branch, spots = {}, None, []
        for before, t in zip([None, *sorted(told)], sorted(told), strict=False):
            lines = []
            for raw in told[t].split("\n"):
                m = sign.match(raw)
                lines.append((m.group(1).count(">") if m else 0, sign.sub("", raw, count=1) if m else raw))
            passages, first = [], 0
            for level, run in groupby(lines, key=lambda x: x[0]):
                bodies = [b for _, b in run]
                passages.append((level, first, bodies))
                first += len(bodies)
            quoted = linked = deepest = 0
            origins = []
            for level, first, bodies in passages:
                asked = [norm("\n".join(bodies)), *map(norm, bodies)]
                if not level or not asked[0]:
                    continue
                quoted, deepest = quoted + 1, max(deepest, level)
                whole, *parts = [max((o for o, p in offers.items() if x and x in p), default=None) for x in asked]
                origin = whole if whole is not None else max((p for p in parts if p is not None), default=None)
                if origin is not None:
                    linked += 1
                    origins.append((level, first, origin))
            reply = min(origins)[2] if origins else before
            opens = before is None or reply != before
            branch = min(t, 0) if before is None else t if opens else branch
            out[c, t] = [quoted, linked, deepest, reply, branch]
            spots.append((branch, t))
            own = told[t]
            if any(level for level, _ in lines):
                own = re.sub(r"\n{3,}", "\n\n", "\n".join(b for level, b in lines if not level)).strip(" ")
            offers[t] = {norm(p) for p in [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n")]} - {""}
        for place, (_, t) in enumerate(sorted(spots)):
            out[c, t].append(place)
    return out


def test_links_are_brute_force(spark):
    rng = random.Random(21)
    said = ["yes", "Not at all.", "see  below", "what about\nthe second line", "first paragraph\n\nsecond one", "", "fine\n\n\n\nthen"]
    rows = []
    for c in range(25):
        turns = sorted(rng.sample(range(-4, 30), rng.randint(1, 12)))
        texts = []
        for n, t in enumerate(turns):
            text = rng.choice(said) + rng.choice(["", f" {rng.randrange(4)}"])
            for _ in range(rng.randrange(3) if n else 0):
                source = rng.choice(texts).split("\n")
                at = rng.randrange(len(source))
                quote = "\n".join(rng.choice([">", "> ", " > "]) + x for x in source[at : at + rng.randint(1, 4)])
                text = rng.choice([quote + "\n" + text, text + "\n" + quote, ">\n" + text, quote.upper() + "\n" + text])
            texts.append(text)
            rows.append((c, t, "user", text))
    found = {(r["conv_id"], r["turn"]): [r[x] for x in ("n_quoted", "n_linked", "deepest", "reply_to", "branch", "position")] for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = brute(rows)
    assert found == want
    assert any(x[1] for x in want.values()) and any(x[4] < 0 for x in want.values())
