import math
import random
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from tapeline.llm import disclosure

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD = "4111 1111 1111 1111"


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, m):
    digits = "".join(c for c in m if c.isdigit())
    return {
        "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def spans(text):
    """Per kind: start, end, value, and the text before and after up to the next match."""
    out = []
    for kind, pattern in PLAIN.items():
        found = [m.span() for m in regex.finditer(pattern, text)]
        for i, (a, b) in enumerate(found):
            if valid(kind, text[a:b]):
                left = found[i - 1][1] if i else 0
                right = found[i + 1][0] if i + 1 < len(found) else len(text)
                out.append((a, list(PLAIN).index(kind), b, text[left:a], text[b:right]))
    return sorted(out)


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(texts, width=40):
    joint, carriers, spread, near = defaultdict(set), defaultdict(set), defaultdict(set), []
    for row, text in enumerate(texts):
        text = text or ""
        for w in regex.findall(disclosure.TERM, low(text)):
            spread[w].add(row)
        for a, k, b, before, after in spans(text):
            carriers[k, text[a:b]].add(row)
            front, back = before[-width:], after[:width]
            words = [(a - len(front) + m.start(), a - len(front) + m.end(), m[0]) for m in regex.finditer(disclosure.TERM, front) if len(before) <= width or m.start() > 0]
            words += [(b + m.start(), b + m.end(), m[0]) for m in regex.finditer(disclosure.TERM, back) if len(after) <= width or m.end() < len(back)]
            for s, e, w in words:
                joint[(k, text[a:b]), low(w)].add(row)
                near.append((row, s, e, (k, text[a:b]), low(w)))
    n = sum(bool(t) for t in texts)
    told = {}
    for (v, w), rows in joint.items():
        own = math.log(n / len(carriers[v]))
        if len(rows) >= 2 and own > 0:
            told[v, w] = round(math.log(len(rows) * n / (len(carriers[v]) * len(spread[w]))) / own, 9)
    extra = defaultdict(set)
    for row, s, e, v, w in near:
        if told.get((v, w), 0) >= 0.5:
            extra[row].add((s, 5 if told[v, w] >= 0.8 else 4, e))
    return [(sorted((a, k, b) for a, k, b, *_ in spans(t or "")), sorted({*extra[i]} | {(a, k, b) for a, k, b, *_ in spans(t or "")})) for i, t in enumerate(texts)]


def rows_of(found):
    line = lambda x: [(s["start"], s["kind"], s["end"]) for s in x]
    return {r.line_id: (line(r.base), line(r.spans)) for r in found}


def test_equals_the_definition(spark):
    rng = random.Random(8)
    words = ["trade", "Größe", "wallet", "holder", "close", "the", "open", "desk"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [text(rng.choice([2, 6, 30])) for _ in range(60)]
    texts += [f"{text(3)} Zacharias of Bremen {text(1)} Hamburg joe@mail.example.com {text(rng.choice([0, 9]))}" for _ in range(8)]
    texts += [f"{text(4)} hamburg" for _ in range(20)]
    texts += [f"card {CARD}, then +49 (30) 1234-5678 and 10.0.0.255 or 256.1.1.1 or 1.2.3.4.5 {text(2)}" for _ in range(3)]
    texts += [None, "", "é😀 a@b.c.d@e.f x@y z+1@q.r_s@t.u", "4111-1111-1111-1112", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "007.000.1.1 +1-2", "a" * 20_000 + "@x.yz " + text(9000), "1 " * 9000 + "+1 " * 50]
    alphabet = "a@.1-+ ()_9\n,é"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.choice([10, 40, 200]))) for _ in range(150)]
    texts += ["+1 (743) 555-3824 only here"] * 2
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate(texts)], "line_id long, value string, spans double, near string").repartition(5)
    got = rows_of(disclosure.scan(df).collect())
    want = brute(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, (texts[i] or "")[:80])
    kinds = {k for w in want for _, k, _ in w[1]}
    assert kinds == {0, 1, 2, 3, 4, 5}


def test_ids_may_repeat_or_lack(spark):
    rows = [(7, "call +1 (743) 555-3824 Anna"), (7, "call +1 (743) 555-3824 Anna"), (None, "call +1 (743) 555-3824 Anna"), (None, None), (8, "plain")]
    got = disclosure.scan(spark.createDataFrame(rows, "line_id long, value string")).collect()
    assert sorted((r.line_id or 0, len(r.base), len(r.told)) for r in got) == [(0, 0, 0), (0, 1, 2), (7, 1, 2), (7, 1, 2), (8, 0, 0)]


def test_sanitised(spark):
    df = spark.createDataFrame([(1, "call Anna at +1 (743) 555-3824 é")] * 2 + [(2, "other text")] * 3, "line_id long, value string")
    found = disclosure.scan(df.limit(2).unionByName(df.filter("line_id = 2"))).filter("line_id = 1").limit(1)
    text = found.withColumn("value", F.lit("call Anna at +1 (743) 555-3824 é")).select(disclosure.sanitised(F.col("value"), F.col("spans"))).first()[0]
    assert text == "  at [PHONE] é"


def test_log_lines_of_the_project(spark, tmp_path):
    (tmp_path / "bot.log").write_text("2026-01-01 00:00:00 INFO TRADE OPEN [BTCUSDT] notify=ops@desk.example.com\nplain\n")
    lines = spark.read.text(str(tmp_path / "bot.log")).withColumn("line_id", F.monotonically_increasing_id())
    assert sorted(len(r.base) for r in disclosure.scan(lines).collect()) == [0, 1]


def test_empty(spark):
    assert disclosure.scan(spark.createDataFrame([], "line_id long, value string")).collect() == []
