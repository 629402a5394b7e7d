import hashlib
import heapq
import itertools
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from feltgrid.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(signature):
    """(cost, letters) by search over all repairs, cheapest and least first."""
    heap, done = [(0, "", 0, "")], set()
    legal = re.compile(r"(s?(ua)+)?")
    begun = re.compile(r"s?(ua)*u?")
    while heap:
        cost, letters, at, roles = heapq.heappop(heap)
        if at == len(signature) and legal.fullmatch(roles):
            return cost, letters
        key = (at, roles[-1:])
        if key in done:
            continue
        done.add(key)
        options = [(5, "I", at, roles + r) for r in "ua"]
        if at < len(signature):
            symbol = signature[at]
            options.append((2, "D", at + 1, roles))
            if symbol != "x":
                extra = 5 * symbol.isupper()
                options += [(1 + extra, "R", at + 1, roles + r) for r in "ua"] + [(extra, "K", at + 1, roles + symbol.lower())]
        for more, letter, next_at, next_roles in options:
            if begun.fullmatch(next_roles):
                heapq.heappush(heap, (cost + more, letters + letter, next_at, next_roles))


def test_the_automaton_finds_the_cheapest_and_least_repair():
    automaton = dialogue.SuffixAutomaton()
    words = ["".join(w) for n in range(5) for w in itertools.product("suaoSUAx", repeat=n)]
    words += ["ua" * 20, "suUuxaaSauaoOxx" * 2, "aaaaaaaa", "uuuuuuuu"]
    words.sort(key=lambda w: w[::-1])
    for w in words:
        assert automaton.repair(w) == cheapest(w), w
    # Each distinct suffix is one node.
    assert automaton.made == len({w[i:] for w in words for i in range(len(w) + 1)})


def expected(rows):
    """The query by the definition, over (conv_id, turn, role, text)."""
    after, ids = defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if hit == 4 else role
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        after[conv] += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return {conv: repaired(after[conv]) for conv in ids}


def repaired(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, signature, n = set(), "", [0, 0, 0]
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        blank, again = not last, (role, text) in seen
        cut = not blank and last[0] not in ".!?"
        seen.add((role, text))
        for i, fault in enumerate((blank, again and not blank, cut and not again)):
            n[i] += fault
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signature += "x" if blank or again else initial.upper() if cut else initial
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = cheapest(signature)
    out, left = [], list(rows)
    for letter in audit:
        _, role, text = (None, "", "") if letter == "I" else left.pop(0)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if out and out[-1][0].startswith("u") else "user"
        out.append((role, text))
    return gaps, *n, illegal, cost, audit, out


AWKWARD = [
    *[(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i} is whole.") for i in range(40)],
    *[(2, i, r, t) for i, (r, t) in enumerate([("system", "Be kind."), ("system", "Be kind."), ("user", "hello"), ("assistant", "\n \t"), ("tool", "x!"), ("", "y?"), ("User", "z.")])],
    (3, None, None, None), (3, None, "user", "Why?"), (3, 5, "user", "Why?"), (3, 5, "user", "Why?"), (3, 9, "assistant", None),
    (None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b. \x0b\x0c"), (4, None, "assistant", "Only this."),
    *[(c, 0, "user", "One?") for c in range(10, 60)], *[(c, 1, "assistant", "Two .") for c in range(10, 60, 3)],
    (5, 7, "user", "word " * 60_000 + "."), (5, 8, "assistant", "Ünïcödé 🎉!"),
]


def test_awkward_rows(spark):
    frame = spark.createDataFrame(AWKWARD, SCHEMA)
    frame = frame.repartition(3).withColumns({c: F.lit("own") for c in ("_kind", "digest", "row", "signature", "cost", "audit", "_hit", "initial", "again")})
    repair = dialogue.Repair(dialogue.damage(dialogue.read_rows(frame)), ids=frame.select("conv_id"))
    want = expected(AWKWARD)
    found = {r.conv_id: r for r in repair.digests().collect()}
    assert found.keys() == want.keys()
    for key, (*counts, out) in want.items():
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        assert tuple(found[key])[1:] == (*counts, digest), key
    turns = defaultdict(list)
    for r in repair.turns().collect():
        turns[r.conv_id].append((r.place, r.role, r.text))
    assert {k: [(r, t) for _, r, t in sorted(v)] for k, v in turns.items()} == {k: v[-1] for k, v in want.items() if v[-1]}


def test_undamaged_conversations_stay(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi!"), (1, 1, "assistant", "Yes?")], SCHEMA)
    row = dialogue.repair_conversations(frame).digests().first()
    assert row.audit == "KK" and row.cost == row.illegal == row.gaps == 0


def test_no_rows(spark):
    frame = spark.createDataFrame([], SCHEMA)
    repair = dialogue.repair_conversations(frame)
    assert repair.digests().count() == repair.turns().count() == 0


def test_no_text_is_shuffled_for_signatures(spark):
    frame = dialogue.read_rows(spark.createDataFrame([(1, 0, "user", "Hi!")], SCHEMA))
    plan = dialogue.signatures(frame, frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(conv_id") <= 2
    sort = plan.split("Exchange hashpartitioning")[0]
    assert "text" not in sort
