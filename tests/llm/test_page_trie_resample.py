import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from brute import sha

from snippetflow.llm import html_extract, prefix_trie, resample

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ------------------------------------------------------------ operator 11 --

PAGES = [
    ('<p>Hello <span class="ad">x</span> world<p>next <b>bold</b> a&amp;b &lt;c&gt; &nbsp;z', "Hello world\nnext bold a&b <c> z"),
    ('<article><header><h1>T</h1></header><p>One<br>two</p><aside>side</aside><section id="comments"><p>c</p></section><form><input>f</form>'
     '<div class="newsletter-box"><p>n</p></div><ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table><footer>by</footer></article><p>out', "T\nOne two\na\nb\nx y\nz"),
    ("<html><head><title>t</title><meta><link><body><nav>m</nav><main><h1>H</h1><p>text</main><footer>f", "H\ntext"),
    ("a < b and c > d <3", "a < b and c > d <3"),
    ('<article><p>x<script>var a="</p>";</script>y</p><style>p{}</style><!-- c --><noscript>no</noscript>', "xy"),
    ("", ""),
    (None, ""),
    ("<nav>only</nav>", ""),
    ('<article><div hidden>h</div><p style="display: none">q</p><pre>a\n  b</pre><button>Go</button>&copy; z</article>', "a b\n© z"),
    ('<article class="comment">c</article><p>real</p>', "real"),
    ('<div class="content"><p>alpha beta gamma</p></div><p>tiny</p>', "alpha beta gamma"),
    ('<article><p>cut <a href="x', "cut"),
    ("<article>" + "<p>w</p>" * 3000 + "</article>", "\n".join(["w"] * 3000)),
]


def test_pages_by_markup(spark):
    df = spark.createDataFrame([(i, f"https://h{i}.example.org/x", h, "other", 0) for i, (h, _) in enumerate(PAGES)],
                               "page_id long, url string, html string, text string, row int")
    got = {r.page_id: r for r in html_extract.extract_text(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i].text == want and got[i].n_chars == len(want), PAGES[i]
    assert html_extract.extract_text(df.limit(0)).collect() == []


def brute_pages(rows, depth=html_extract.DEPTH, min_words=html_extract.MIN_WORDS):
    """Every suffix against every suffix of the host's other pages."""
    read = []
    for pid, url, h in rows:
        blocks = html_extract.read_blocks(h or "")
        level = html_extract.level_of(blocks)
        longest = max((t for k, t in blocks if k != html_extract.OUT), key=lambda t: (len(t), t), default="")
        free = [(i, t) for i, (k, t) in enumerate(blocks) if k == html_extract.OUT or k < html_extract.MAIN]
        norm = lambda t: re.sub(r"\d+", "0", t).casefold()
        read.append((pid, html_extract.host_of(url), norm(longest), [norm(t) for _, t in free], free, blocks, level))
    out = []
    for pid, host, who, names, free, blocks, level in read:
        gone = set()
        for i in range(len(names) if level < html_extract.MAIN else 0):
            best = 0
            for _, host2, who2, names2, *_ in read:
                if host2 == host and who2 != who:
                    for j in range(len(names2)):
                        n = 0
                        while n < depth and i + n < len(names) and j + n < len(names2) and names[i + n] == names2[j + n]:
                            n += 1
                        best = max(best, n)
            words, need = 0, depth
            for n in range(1, depth + 1):
                words += len(free[i + n - 1][1].split()) if i + n <= len(free) else 0
                if words >= min_words:
                    need = n
                    break
            if best >= need:
                gone |= {free[i + n][0] for n in range(best)}
        out.append((pid, "\n".join(t for i, (k, t) in enumerate(blocks) if (k == level if level >= html_extract.MAIN else level <= k < html_extract.MAIN) and i not in gone)))
    return sorted(out)


def site(n=120, seed=5):
    """Pages without an article: menus, notices, unique paragraphs, copies, a host that has most of them."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("red green blue ash oak elm fir yew 1 22 été".split())
    notice = [" ".join(word() for _ in range(rnd.randint(3, 14))) for _ in range(4)]
    menu = ["Home", "News 1", "Shop", "Help", "Jobs"]
    rows, bodies = [], []
    for i in range(n):
        host = rnd.choice(["big.example.org"] * 4 + [f"h{rnd.randint(0, 5)}.example.org", "bad url"])
        body = rnd.choice(bodies) if bodies and rnd.random() < .25 else [" ".join(word() for _ in range(rnd.randint(2, 40))) for _ in range(rnd.randint(0, 5))]
        bodies.append(body)
        parts = [f"<li>{x}" for x in menu] * (rnd.random() < .7) + [f"<div>{rnd.choice(notice)}</div>"] + [f"<p>{x}" for x in body] + [f"<div>{notice[0]} {i}</div>"]
        url = None if rnd.random() < .05 else f"https://{host}/{i}" if " " not in host else host
        rows.append((i, url, ("<article>" + "".join(parts) + "</article>") if rnd.random() < .1 else "".join(parts)))
    return rows + rows[:3]


@pytest.mark.parametrize("parts", [1, 7])
def test_repeated_runs_equal_brute_force(spark, parts, monkeypatch):
    rows = site()
    monkeypatch.setattr(html_extract, "TASK_SUFFIXES", 40 if parts > 1 else 10_000)      # partitions cut between and inside equal runs
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_extract.extract_text(df).collect())
    want = brute_pages(rows)
    assert got == want
    assert sum(len(t) for _, t in want) < sum(len(t) for _, t in brute_pages(rows, 99, 10**6))


def test_articles_go_through_the_suffix_array(spark):
    notice = "this notice of nine words stands in every article"
    rows = [(i, "https://a.example.org/x", f"<nav>m</nav><article><p>own text {'abc'[i] * 80}</p><p>{notice}</p></article>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = html_extract.suffixes(df.withColumnRenamed("page_id", "row"))
    assert sorted((r.row, r.at, r.vouched) for r in index.collect()) == [(i, at, at > 0) for i in range(3) for at in range(3)]
    assert sorted((r.row, r.at, r.n, r.vouched) for r in html_extract.repeated(index).collect()) == [(i, 2, 1, True) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    assert got == {i: f"own text {'abc'[i] * 80}\n{notice}" for i in range(3)}


# ------------------------------------------------------------ operator 12 --

def brute_trie(rows, family=100, heads=6, rebuild=True):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append(((t is not None, t or 0), r, sha(f"{len(r)}:{r}{x}"), x))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - c % family, [])[:h] + v[h:] if rebuild else v
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            if k:
                saved[k[:d]] += (len(m) - 1) * len(k[-1][1])
    return sorted(((min(m), len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, ends[k])))) for k, m in members.items()),
                  key=lambda r: r[:2])


def chats():
    rnd = random.Random(1)
    rows = [(7, i, "user" if i % 2 else "assistant", f"t{i % 50}") for i in range(120)]          # one long conversation
    for c in range(100, 140):
        for _ in range(rnd.randint(1, 9)):
            rows.append((c, None if rnd.random() < .1 else rnd.randint(0, 4), rnd.choice([None, "user", "assistant", ""]), rnd.choice([None, "", "a", "b", "c é"])))
    for c in range(200, 240):          # copies
        rows += [(c, j, "user", f"same{j}") for j in range(6)]
    return [*rows, (None, 1, "user", "x"), (5, 0, "user", "alone"), (310, 0, "u", "q"), (310, 0, "u", "q"), (2 ** 40, 0, "user", "far")]


def test_trie_equals_brute_force(spark):
    rows = chats()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, x int, depth string").repartition(5)
    for turns, rebuild in ((prefix_trie.branched(df), True), (prefix_trie.conversations(df), False)):
        got = sorted((tuple(r) for r in prefix_trie.prefix_trie(turns).collect()), key=lambda r: r[:2])
        assert got == brute_trie(rows, rebuild=rebuild)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.branched(df)).collect() == []


def test_ends_cut_by_partitions_are_joined(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 50)
    ids = {(1, 1, 1): list(range(0, 3000, 3)), (2, 9, 1): [5], (3, 1, 2): list(range(500))}
    df = spark.createDataFrame([(*k, c) for k, v in ids.items() for c in v], "x long, y long, depth long, conv_id long").repartition(6)
    got = {(r.x, r.y, r.depth): r.ends_sha256 for r in prefix_trie.ends_digests(df).collect()}
    assert got == {k: sha(",".join(map(str, v))) for k, v in ids.items()}


# ------------------------------------------------------------ operator 13 --

def brute_resample(docs, target, buckets=10_000):
    def feats(t):
        w = WORD.findall((t or "").translate(LOWER))
        return [zlib.crc32(x.encode()) % buckets for x in [*w, *(" ".join(p) for p in zip(w, w[1:]))]], len(w)
    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(feats(x)[0])
    for x in target:
        t.update(feats(x)[0])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        f, n = feats(x)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), n))
    return out


def test_resample_equals_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["a", "Bé", "x" * 70, "日本", "zz9", "y" * 64, "don", "t", "Q" * 65, "of", "the"]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "--- !"), (903, "the " * 60_000), (904, "w" * 40_000), docs[3], (None, "the a " * 30)]
    target = ["the zz9 of", None, "日本 " * 50, "Bé don t" * 9]
    d = spark.createDataFrame([(*x, "x", 3) for x in docs], "doc_id long, text string, row string, rank int").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.ranked(d, t).collect()
    want = brute_resample(docs, target)
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got), key=order) == sorted(want, key=order)
    long = sorted(((-r[3], r[0] is None, r[0] or 0) for r in want if r[4] >= 20))
    drawn = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank)
    assert [x[1:] for x in drawn] == long[:25 * len(long) // 100] and [x[0] for x in drawn] == list(range(1, len(drawn) + 1))
    kept = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), t)
    assert kept.columns == ["doc_id", "text"] and kept.count() == len(drawn)


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.ranked(none, none).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.n_features, r.rank) for r in resample.ranked(one, none).collect()] == [(5, None)]
