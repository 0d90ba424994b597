import math
import random
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from snippetflow.llm import chat, decontaminate, licences, open_quality, packing, pii, quality, toxicity
from snippetflow.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def io_path(spark):
    from snippetflow.sources.io import scratch_path
    return scratch_path(spark, "llm")


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_encoder_equals_the_library():
    from snippetflow.llm import ragged as R
    import pyarrow as pa
    rnd = random.Random(1)
    parts = ["word", " word", "  two", "\n\n", "\n ", " \n", "\t", "don't", "we'll", "'s", "''s", " 'tis", "'re's", "I'VE", "été", "Ünder", "x×y", "日本", "12", " 34a",
             "!?", " --", "...", "<|endoftext|>", " ", "\x1c", "'", "'d", "a'mb", " ", "   ", "é'll", "’s", "ﬁ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(1500)] + ["", "a" * 5000, " " * 300, "'s" * 100]
    tok = Tokenizer.from_file(PATH)
    enc = Encoder(PATH)
    for _ in range(2):
        for lo, data, offs in R.chunks(pa.array(texts), 2000):
            for i, ids in enumerate(enc.rows(data, offs)):
                assert ids.tolist() == tok.encode(texts[lo + i], add_special_tokens=False).ids, texts[lo + i]
        enc.forget()


def test_best_two_fit_places_everything():
    rnd = np.random.default_rng(0)
    for capacity, n in ((2048, 3000), (10, 50), (7, 0)):
        sizes = rnd.integers(1, capacity, n)
        bins, offsets = packing.best_two_fit(sizes, capacity)
        used = {}
        for b, o, s in sorted(zip(bins.tolist(), offsets.tolist(), sizes.tolist(), strict=True)):
            assert used.get(b, 0) == o
            used[b] = o + s
        assert all(u <= capacity for u in used.values())
        assert len(used) <= max(int(sizes.sum()) / capacity, int((2 * sizes > capacity).sum())) * 1.03 + 2


def test_pack(spark):
    rows = [r for r in brute.awkward(40) if r[0] is not None]
    rows = list(dict(rows).items())
    got = packing.pack(brute.frame(spark, rows), PATH, shard_pieces=16, with_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    by, seq = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        parts = sorted(by[d], key=lambda r: r.piece)
        for i, r in enumerate(parts):
            assert (r.piece, r.start) == (i, at) and r.ids == ids[at:at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            assert i == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    for v in seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(brute.frame(spark, []), PATH).count() == 0


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "", None, "a\nb", "<|endoftext|>", "日本 <| é", "<|im_end|>" * 50, "x" * 5000]
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", "sys\ntem\\n", None]), rnd.choice(said), "x") for c in (1, 2, None) for t in range(12)]
    rows += rows[:2] + [(9, None, "assistant", "last", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df, PATH), PATH).collect()}
    for c in (1, 2, None, 9):
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: key((r[1], r[2], r[3])) if r[1] is not None else ((False, -1),))
        turns = sorted(turns, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[1], r[2], r[3])))
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == brute.sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns))
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), brute.sha(learned))
    stored = io_path(spark)
    chat.format_chats(df, PATH).repartition(5, "turn_no").write.parquet(stored)
    again = {r.conv_id: r for r in chat.read_back(spark.read.parquet(stored), PATH, stored=True).collect()}
    assert again == got
    with pytest.raises(Exception, match="not in order"):
        chat.read_back(spark.read.parquet(stored), PATH).collect()
    formatted = chat.format_chats(df, PATH).collect()
    reserved = Tokenizer.from_file(PATH).get_vocab_size()
    assert all(sum(i >= reserved for i in r.ids) == 2 and len(r.ids) == len(r.loss_mask) for r in formatted)
    assert chat.read_back(chat.format_chats(df.limit(0), PATH), PATH).count() == 0


@pytest.mark.parametrize("text", ["<|a", "<\\|", "<<||", "\\<|\\", "<\\\\\\||"])
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text + "\n\\n")) == text + "\n\\n"


def test_pii(spark):
    rnd = random.Random(3)
    parts = ["a@b.co", "x.y+z@d-e.f.g@h.i", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999",
             "+49 30 1234567 ", "+12", "é ", " ", ",", "card ", "@", "+", "1" * 14, "0" * 16, "7" * 40, "a@b", "..", "日", "5500 0000 0000 0004 "]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for i in range(300)] + [(999, None), (998, "9" * 30_000), (997, "a." * 20_000)]
    got = {r.doc_id: r for r in pii.digest(pii.find_spans(brute.frame(spark, rows))).collect()}
    for d, t in rows:
        spans = brute.pii(t)
        text = ",".join(f"{brute.PII[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[d].base_sha256 == brute.sha(text), t
        assert [got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(text.split(",")) <= set(got[d].spans.split(",")) | {""}
    assert pii.find_spans(brute.frame(spark, [])).count() == 0


def test_pii_account_numbers_and_context(spark):
    rows = [(1, "pay to IBAN DE89 3704 0044 0532 0130 00 now"), (2, "DE89 3704 0044 0532 0130 01"), (3, "SSN 123-45-6789"), (4, "part 123-45-6789")]
    got = {r.doc_id: [(s.kind, round(s.score, 2)) for s in r.spans] for r in pii.find_spans(brute.frame(spark, rows, extra=False)).collect()}
    assert ("iban", 1.0) in got[1] and not any(k == "iban" for k, _ in got[2])
    assert got[3] == [("ssn", 0.6)] and got[4] == []


def dice(a, b):
    import collections
    x, y = (collections.Counter(zip(w, w[1:], strict=False)) for w in (a, b))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def passages(w):
    """(start, licence, dice) of the windows that match: every place of a probe aligned with every place in its template."""
    out, r = [], licences.THRESHOLD / (2 - licences.THRESHOLD)
    for name, text in licences.TEMPLATES:
        t = re.findall(r"[^\W_]+", text.lower())
        grams = [" ".join(t[i:i + 2]) for i in range(len(t) - 1)]
        low = math.ceil(len(grams) * r - 1e-9)
        probes = set(sorted(grams, key=lambda g: (-len(g), g))[:len(grams) - low + 1])
        for i in range(len(w) - 1):
            for j, g in enumerate(grams):
                if g in probes and g == " ".join(w[i:i + 2]):
                    x = w[max(0, i - j):max(0, i - j + len(t))]
                    if len(x) > 1 and (score := round(dice(x, t), 9)) >= licences.THRESHOLD:
                        out.append((max(0, i - j), name, score))
    return out


def test_licences_across_lines_and_inside_sentences(spark):
    apache = "This file is licensed to you under the Apache License, Version 2.0; you may not use this file except in compliance with the License."
    rows = [(1, "# Copyright 2020 someone\n# This file is licensed to you under the Apache License, Version 2.0; you may\n"
                "#   not use this file except in compliance with the License.\nimport os\nprint(1)\n" + "x = 1\n" * 300),
            (2, "See README. Released under the MIT License. Contributions are welcome."), (3, "word " * 50 + apache + " word" * 5000), (4, "word " * 300)]
    got = {r.doc_id: r for r in licences.scan_licences(brute.frame(spark, rows)).collect()}
    assert got[1].licences == "Apache-2.0" and got[1].best_dice == 1.0 and "3" in got[1].passages.split(",")
    assert (got[2].licences, got[2].best_dice, got[2].passages, got[2].n_matches) == ("MIT", 1.0, "2", 0)
    assert got[3].licences == "Apache-2.0" and got[3].best_dice == 1.0
    assert (got[4].licences, got[4].n_passages, got[4].passages) == ("", 0, "")


def test_licences(spark):
    rnd = random.Random(4)

    def words(t):
        return re.findall(r"[^\W_]+", t.lower())

    rows = [(0, None), (1, ""), (2, "MIT"), (3, "Released under the MIT License.")]
    for i in range(4, 120):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            w = list(rnd.choice(licences.TEMPLATES)[1].split())
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(["foo", "the", "License"])
            lines.append(" ".join(w * rnd.choice([1, 1, 1, 2])))
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r for r in licences.scan_licences(brute.frame(spark, rows)).collect()}
    for d, t in rows:
        lines = (t or "").split("\n")
        units = [(j, words(x)) for j, x in enumerate(lines)] + ([(-1, words(t or ""))] if len(lines) > 1 else [])
        names, at, best = set(), set(), None
        for j, w in units:
            if len(w) < 2:
                continue
            score = [(round(dice(w, words(text)), 9), name) for name, text in licences.TEMPLATES]
            top = max(score)[0]
            if top >= licences.THRESHOLD:
                names |= {n for s, n in score if s == top}
                at.add(j)
                best = max(best or 0, top)
        starts = {}
        for start, name, score in passages(words(t or "")):
            starts.setdefault(start, []).append((score, name))
        for start, met in starts.items():
            names |= {n for x, n in met if x == max(met)[0]}
            best = max(best or 0, max(met)[0])
        assert (got[d].licences, got[d].units, got[d].n_matches, got[d].best_dice) == (",".join(sorted(names)), ",".join(map(str, sorted(at))), len(at), best), t
        assert (got[d].n_passages, got[d].passages) == (len(starts), ",".join(map(str, sorted(starts))))
    assert licences.scan_licences(brute.frame(spark, [])).count() == 0


def test_licences_whole_text_with_many_empty_lines(spark):
    mit = max((t for n, t in licences.TEMPLATES if n == "MIT"), key=len).split()
    lines = [" ".join(mit[i:i + 11]) for i in range(0, len(mit), 11)]
    rows = [(1, "\n".join(lines) + "\n" * 200), (2, "\n" * 300 + (" \n" * 300).join(lines)), (3, "\n" * 400)]
    got = {r.doc_id: r for r in licences.scan_licences(brute.frame(spark, rows)).collect()}
    assert [(got[d].licences, got[d].units, got[d].best_dice) for d in (1, 2, 3)] == [("MIT", "-1", 1.0), ("MIT", "-1", 1.0), ("", "", None)]


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_contamination(spark, block_words):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["Été", "a"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 8, 13, 14, 40])))) for i in range(12)]
    items += [(12, None), (13, "--"), (3, items[3][1]), (None, items[5][1]), (14, "a " * 40)]
    rows = [(0, None), (1, ""), (2, "a " * 3000)]
    for i in range(3, 80):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            piece = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, max(0, len(piece) - 5))
            at = rnd.randint(0, len(w))
            w[at:at] = piece[a:a + rnd.randint(5, 30)]
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
    rows.append(rows[5])
    df = brute.frame(spark, rows)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = decontaminate.contamination(df, bench, block_words=block_words).collect()
    want = brute.hits(rows, items)
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got))) == sorted(map(str, want))
    kept = decontaminate.drop_contaminated(df, bench, block_words=block_words)
    assert kept.columns == df.columns and kept.count() == sum(not w[4] for w in want)
    none = decontaminate.contamination(df, bench.limit(0))
    assert none.where("contaminated or n_hit > 0").count() == 0 and none.count() == len(rows)
    assert decontaminate.contamination(brute.frame(spark, []), bench).count() == 0


def test_chain_equals_plain_recursion():
    rnd = np.random.default_rng(1)
    lens = [0, 1, 5, 300, 0, 128, 7]
    first = np.concatenate([[0], np.cumsum(lens)])
    u, trans = rnd.normal(size=first[-1]), rnd.normal(size=(2, 2))
    p, _, _ = toxicity.marginals(u, trans, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        e = np.stack([np.ones(b - a), np.exp(u[a:b])], axis=1)
        al, be = [], [np.ones(2)]
        for t in range(b - a):
            x = e[t] * (al[-1] @ np.exp(trans) if al else 1)
            al.append(x / x.sum())
        for t in range(b - a - 1, 0, -1):
            x = np.exp(trans) @ (e[t] * be[-1])
            be.append(x / x.sum())
        for t in range(b - a):
            x = al[t] * be[b - a - 1 - t]
            assert abs(p[a + t] - x[1] / x.sum()) < 1e-9


def test_toxicity_learns_and_holds_out(spark):
    rnd = random.Random(6)
    clean = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        w = [rnd.choice(clean) for _ in range(rnd.randint(5, 40))]
        bad = i % 4 == 0
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["Vilest", "vileness", "awful"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), "x"))
    rows += [(1000, None), (1001, ""), (1002, "vilest"), rows[0]]
    df = brute.frame(spark, rows)
    lab = spark.createDataFrame(labels + [(None, 1, "x"), (7, None, "x"), labels[3]], "doc_id long, toxic int, text string")
    model = toxicity.fit(df, lab)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows)
    hold = [r for r in got if r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in hold]) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[1002].predicted == 1 and by[1000].predicted == by[1001].predicted == 0 and by[1000].score == by[1001].score
    text = rows[0][1]
    assert [text[s.start:s.end].lower() in ("vilest", "vileness", "awful") for s in by[0].spans] == [True]
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in got)
    flat = toxicity.fit(df, lab.limit(0))
    assert {r.score for r in toxicity.score(df, flat).collect()} == {0.0}
    assert toxicity.score(brute.frame(spark, []), model).count() == 0


def test_thresholds_do_not_depend_on_the_layout(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([2.0, 3.25, rnd.uniform(1, 50)])) for _ in range(700)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "lang string, perplexity double").repartition(parts)
        got = {r.lang: r.own for r in quality._thresholds(df, ["lang"], .9).collect()}
        for lang in ("a", "b", None):
            own = sorted(math.ceil(p * 1000) for x, p in rows if x == lang)
            assert got[lang] == own[math.ceil(.9 * len(own)) - 1] / 1000
    assert quality._thresholds(df.limit(0), [], .9).first()[0] is None


def plain_open(texts):
    """Interpolated modified Kneser-Ney over raw characters by dictionaries: probability of a character after its context."""
    import collections
    n = open_quality.ORDER
    tables = {n: collections.Counter()}
    for t in texts:
        s = [None] * (n - 1) + list(t)
        tables[n].update(tuple(s[i - n + 1:i + 1]) for i in range(n - 1, len(s)))
    for k in range(n - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
    discount, context = {}, {k: collections.defaultdict(lambda: [0, 0.0]) for k in tables}
    for k, t in tables.items():
        c = collections.Counter(t.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0
        d = [1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3] if c[3] else 1.5] if y else [0.5] * 3
        discount[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)] if y else d
        for g, m in t.items():
            context[k][g[:-1]][0] += m
            context[k][g[:-1]][1] += discount[k][min(m, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(tables[1]) + 1)
        total, taken = context[len(g)].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        c = tables[len(g)].get(g, 0)
        return ((c - discount[len(g)][min(c, 3) - 1] if c else 0) + taken * p(g[1:])) / total
    return p


@pytest.mark.parametrize("block_bytes", [1 << 25, 300])
def test_open_quality_equals_plain_model(spark, block_bytes):
    import math
    rnd = random.Random(9)
    parts = ["alpha", "Beta", "été", "日本", "本日", "gamma.", "12", "😀", "x\0y"]
    good = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(3, 30)))) for i in range(40)]
    rows = good + [(100, "zzzz qqqq xxxx"), (101, None), (102, ""), (103, "日"), (104, "月"), good[0]]
    df = brute.frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, "x") for i, _ in good] + [(100, 0, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    got = open_quality.score(df, labels, block_bytes=block_bytes).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    p = plain_open([t for _, t in good] + [good[0][1]])
    n = open_quality.ORDER
    for r in got:
        s = [None] * (n - 1) + list(dict(rows)[r.doc_id] or "")
        want = sum(math.log(p(tuple(s[i - n + 1:i + 1]))) for i in range(n - 1, len(s)))
        assert r.n_symbols == len(s) - n + 1 and abs(r.log_prob - want) < 1e-6 * max(1, abs(want)), r
    by = {r.doc_id: r for r in got}
    # the fixed classes gave these two texts the same score
    assert by[103].log_prob > by[104].log_prob
    assert not by[100].kept and not by[101].kept and by[101].perplexity is None
    none = open_quality.score(df, labels.limit(0), block_bytes=block_bytes).collect()
    assert all(r.kept == (r.perplexity is not None) for r in none)
    assert open_quality.score(brute.frame(spark, []), labels).count() == 0


def test_open_quality_sends_names_in_small_batches(monkeypatch):
    text = "".join(chr(97 + i * i % 23) + chr(0x4E00 + i % 997) for i in range(3000))
    monkeypatch.setattr(open_quality, "SENT", 100)
    monkeypatch.setattr(open_quality, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    sent = list(open_quality._wanted(0, 1 << 25)(iter([pa.RecordBatch.from_arrays([pa.array([text, "aa", ""])], names=["text"])])))
    assert max(b.num_rows for b in sent) <= 100
    got = [k for b in sent for k in b.column(1).to_pylist()]
    n, want = open_quality.ORDER, set()
    for t in (text, "aa"):
        s = [0] * (n - 1) + [int.from_bytes(c.encode(), "big") + 1 for c in t]
        for i in range(n, len(s) + 1):
            want |= {tuple(s[i - k:i]) for k in range(1, n + 1)} | {tuple(s[i - k:i - 1]) for k in range(2, n + 1)}
    want = [int(open_quality.keys(np.array([g]))[0]) for g in want]
    assert sorted(got) == sorted(want)


def test_open_quality_model_grows_with_the_trusted_text(spark):
    texts = [("".join(chr(0x4E00 + 40 * i + j) for j in range(40)),) for i in range(100)]
    sizes = [open_quality.train(spark.createDataFrame(texts[:k], "text string"))[0].count() for k in (10, 100)]
    assert sizes[1] > 9 * sizes[0]


def test_repeated_words_cost_their_number_not_their_pairs():
    import time

    import pyarrow as pa

    from snippetflow.llm import ragged as R

    def hashed(texts):
        (_, data, offs), = R.chunks(pa.array(texts), 1 << 30)
        h, _, _, first = R.word_hashes(data, offs, R.ALNUM)
        return h, first
    h, first = hashed(["w " * 8000, "a b " * 4000])
    shard = decontaminate.Shard([("1", hashed(["w " * 800])[0]), ("2", hashed(["b a " * 400])[0])], 13)
    began = time.time()
    found = list(shard.hits(h, first))
    assert time.time() - began < 5
    assert {(row, item) for row, _, _, item in found} == {(0, 0), (1, 1)}
    assert {x for row, a, b, _ in found if row == 0 for x in (a, b)} >= {0, 8000}
    # against all pairs of windows, texts of few words
    rnd = random.Random(0)
    for _ in range(60):
        words = lambda n: ((w := [rnd.choice("abc") for _ in range(rnd.randint(1, 6))]) * n)[:n] + rnd.choices("abcd", k=rnd.randint(0, 9))
        docs, items = [words(rnd.randint(1, 60)) for _ in range(3)], [words(rnd.randint(1, 40)) for _ in range(3)]
        h, first = hashed([" ".join(d) for d in docs])
        shard = decontaminate.Shard([(str(i), hashed([" ".join(w)])[0]) for i, w in enumerate(items)], 13)
        got = {(row, item, x - int(first[row])) for row, a, b, item in shard.hits(h, first) for x in range(a, b)}
        want = set()
        for i, d in enumerate(docs):
            for j, w in enumerate(items):
                n = min(13, len(w))
                have = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
                want |= {(i, j, k + x) for k in range(len(d) - n + 1) if tuple(d[k:k + n]) in have for x in range(n)}
        assert got == want
