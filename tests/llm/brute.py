"""Plain Python versions of the operators and a table of awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re

LOWER = {i: i + 32 for i in range(65, 91)}


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def awkward(n: int = 60, seed: int = 7) -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows, near copies, long texts, odd characters."""
    rnd = random.Random(seed)
    vocab = ["alpha", "beta", "Gamma", "delta", "été", "über", "x1", "2024", "don't", "naïve", "日本", "we'll", "ok.", "—"]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(4, 90))] for _ in range(6)]
    rows: list[tuple] = [(0, None), (1, ""), (2, " \t\n"), (3, "word"), (4, "a b c"), (5, "a  b c "), (6, "abc"),
                         (7, "lorem " * 4000), (8, "lorem " * 4000), (9, "x" * 30_000)]
    for i in range(10, n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            at = rnd.randrange(len(words) + 1)
            words[at:at + rnd.randint(0, 2)] = [rnd.choice(vocab)] * rnd.randint(0, 2)
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(words)))
    rows += [rows[12], rows[12], rows[20], (None, "no id here at all"), (None, rows[15][1])]
    return rows


def frame(spark, rows: list[tuple], extra: bool = True):
    """The rows as a table read from files, with columns of clashing names."""
    import tempfile
    path = tempfile.mkdtemp(prefix="llm-test-") + "/t"
    df = spark.createDataFrame([(*r, "x", 1, "en") for r in rows], "doc_id long, text string, row string, shard int, lang string")
    if not extra:
        df = df.select("doc_id", "text")
    df.repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    return df.selectExpr("*", "'other' as TEXT", "lang as k", "lang as load") if extra else df


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else (tuple(w[i:i + k]) for i in range(len(w) - k + 1)))


def near(rows: list[tuple]) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    at = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in at[x] if j > i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low.get(find(i)), links[i]) for i, (d, _) in enumerate(rows)]


def exact(rows: list[tuple]) -> list[tuple]:
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for i, x in enumerate(norm):
        groups[x].append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        g = groups[norm[i]]
        best = min(g, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        out.append((d, rows[best][0], len(g), sha(norm[i])))
    return out


def repeats(texts: list, length: int = 200) -> list[tuple]:
    count: collections.Counter = collections.Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] += 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def hits(rows: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j:j + n])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w, on, found = words(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[j:j + n]))) is not None:
                    on.update(range(j, j + n))
                    found |= {str(x) for x in got if x is not None}
        out.append((d, len(w), len(on), sorted(found), bool(on) and 20 * len(on) >= len(w)))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def pii(text: str | None) -> list[tuple]:
    out = []
    for k, (_, p) in enumerate(PII):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn(d) \
                    or k == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)
