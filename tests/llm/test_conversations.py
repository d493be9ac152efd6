import hashlib
import random
import re
import zlib
from collections import Counter

from glossmeter.llm import conversations as C

WORD = "[^\x20\x09-\x0d]"


def damage(rows):
    """Rows (conv_id, turn, role, text) after damage, per conversation in order."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        found[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv in found:
        found[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return found


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = re.findall(WORD, text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, lines) by search over all states, whole strings at a time."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def better(into, state, way):
        if state not in into or way < into[state]:
            into[state] = way

    def put_in(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                for role in "ua":
                    if (state, role) in step:
                        better(states, step[state, role], (cost + 3, audit + "I", lines + (f"{names[role]}:",)))
    for (_, role, text), mark in zip(rows, marks):
        put_in(best)
        new = {}
        for state, (cost, audit, lines) in best.items():
            better(new, state, (cost + 4, audit + "D", lines))
            if mark in ("blank", "duplicate"):
                continue
            more = cost + (3 if mark == "truncated" else 0)
            if (state, role[:1]) in step:
                better(new, step[state, role[:1]], (more, audit + "K", lines + (f"{role}:{text}",)))
            for other in "ua":
                if (state, other) in step:
                    better(new, step[state, other], (more + 3, audit + "R", lines + (f"{names[other]}:{text}",)))
        best = new
    put_in(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute_force(rows):
    out = []
    for conv, left in damage(rows).items():
        marks = faults(left)
        turns = {t for t, _, _ in left if t is not None}
        cost, audit, lines = cheapest(left, marks)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(left, left[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n, longest=9):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            if rng.random() < 0.05:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["A b.", "c d!", "no end", "", " \t", "x?", None, "é fin. ", "same."])
            rows.append((conv, turn if rng.random() > 0.05 else None, role, text))
            if rng.random() < 0.1:
                rows.append((conv, turn, role, rng.choice([text, "other."])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def query(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/conversations.parquet")
    return C.repair_documents(spark, str(path))


def test_against_brute_force(spark, tmp_path):
    rows = made(1, 500) + [(None, t, r, x) for _, t, r, x in made(2, 2)] + [(9000, 0, "user", "b"), (-5, None, None, None), (-6, None, "assistant", "b."), (-6, None, "user", "a.")]
    got = query(spark, rows, tmp_path)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(rows)


def test_long_conversations_in_blocks(spark, tmp_path, monkeypatch):
    """One conversation of most rows, cut into blocks that are multiplied in several rounds, and rows that repeat thousands of times."""
    rng = random.Random(6)
    rows = made(3, 40)
    rows += [(7000, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"t{t}.", f"t{t}.", f"t{t}"])) for t in range(9000)]
    rows += [(7001, 5, "user", "again."), (7001, 6, "assistant", "yes.")] * 5000
    want = brute_force(rows)
    got = sorted((tuple(r) for r in query(spark, rows, tmp_path).collect()), key=str)
    assert got == want
    monkeypatch.setattr(C, "BLOCK", 50)
    blocks, _ = C.sequences_of(C.damaged(spark.createDataFrame(rows[:2000] + rows[-2000:], SCHEMA)))
    assert blocks.count()


def test_empty(spark, tmp_path):
    assert query(spark, [], tmp_path).count() == 0


def test_repaired_lines(spark):
    rows = made(4, 60)
    got = {r["conv_id"]: r["repaired"] for r in C.repair(spark.createDataFrame(rows, SCHEMA).withColumn("conv", C.F.lit("clash")).withColumn("audit", C.F.lit(1))).collect()}
    left = damage(rows)
    assert got == {c: "\n".join(cheapest(left[c], faults(left[c]))[2]) for c in left}
    for text in got.values():
        initials = "".join(line[0] for line in text.split("\n")) if text else ""
        assert re.fullmatch("(s?(ua)+)?", initials)


def test_matrices_by_grammar_or_one_by_one(spark):
    rng = random.Random(8)
    sequences = {bytes(rng.choice([4, 8, 4, 8, 0, 6, 13, 9]) for _ in range(rng.randint(1, 30))) for _ in range(200)} | {bytes([4]) * 5000}
    grammar = C.learn(spark.createDataFrame([(bytearray(s),) for s in sequences], "sequence binary"))
    assert len(grammar.rules) > 20 and max(max(r) for r in grammar.rules) >= C.SYMBOLS        # rules of rules
    assert len(grammar.compress([4] * 5000)) < 100
    plain = C.Grammar([], [])
    for s in sequences:
        assert C.ended(grammar.evaluate(grammar.compress(list(s)))) == C.ended(plain.evaluate(list(s)))


def test_ropes():
    rng = random.Random(5)
    ropes = [(C.Rope(""), "")]
    for _ in range(300):
        a, b = rng.choice(ropes), rng.choice(ropes)
        extra = "".join(rng.choice("KD") for _ in range(rng.randint(0, 40)))
        if len(a[1]) + len(b[1]) < 5000:
            ropes.append((a[0] + b[0] + C.Rope(extra), a[1] + b[1] + extra))
    assert all(str(r) == t and r.size == len(t) for r, t in ropes) and max(len(t) for _, t in ropes) > 1000
    for _ in range(2000):
        (a, x), (b, y) = rng.choice(ropes), rng.choice(ropes)
        assert (a < b) == (x < y)


def test_pairs_of_a_run_are_counted_apart():
    counts = Counter()
    C.pair_counts([1, 1, 1, 1, 1, 2], counts)
    assert counts == {(1, 1): 2, (1, 2): 1}
    assert C.replaced([1, 1, 1, 1, 1, 2], {(1, 1): 16}) == [16, 16, 1, 2]


def test_chosen_pairs_do_not_touch():
    assert C.chosen([(1, 2, 9), (2, 3, 8), (4, 2, 7)]) == [(1, 2), (4, 2)]
