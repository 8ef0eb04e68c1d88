"""Training-data operators against the public libraries, brute force and round trips."""

import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest

from lexiloom.llm import bpe, gif, hashing, licences, neardup, ordermin, packing, quality, unigram, warc
from lexiloom.llm.common import IntMap

RND = random.Random(5)


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    out = ["", " ", "   ", "\n\n a  b\n\t c", "don't I'LL we'll 12 x1", "a\x1cb \x1f", "<|endoftext|> b<|startoftext|>c", "naïve ÉCOLE ΑΣ İx é", "日本語 テスト", " x 　y", "x" * 5000, "ab " * 3000]
    while len(out) < n:
        top = rnd.choice([64, 128, 0x250, 0x3000, 0x20000])
        text = "".join(chr(c) for c in (rnd.randrange(top) for _ in range(rnd.randrange(50))) if not 0xD800 <= c < 0xE000)
        if rnd.random() < 0.4:
            text = "".join(rnd.choice(" \n\t\r\x0b\x85\xa0aA1.'s") for _ in range(20)) + text
        out.append(text)
    return out


def test_int_map():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 5000))
    table = IntMap(keys, np.arange(len(keys)), -1)
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert (table.get(np.setdiff1d(np.arange(1000), keys)) == -1).all()
    assert (IntMap(np.zeros(0, np.int64), np.zeros(0), np.nan).get(np.arange(3)) != 0).all()


def test_bpe_matches_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.BacktrackingBpe(path)
    texts = odd_texts(1500)
    own.prepare(texts)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == want
        assert own.decode(np.array(want, dtype=np.int64)) == library.decode(want, skip_special_tokens=False)
        assert own.decimal_bytes(np.array(want, dtype=np.int64)) == ",".join(map(str, want)).encode()


def test_bpe_many_words_as_one_by_one():
    own = bpe.BacktrackingBpe(public_tokenizers.path("byte_bpe_50k.json"))
    words = [bytes(RND.randrange(97, 105) for _ in range(RND.randrange(1, 30))) for _ in range(500)]
    assert own.encode_words(words) == [np.array(own.encode_word(w), dtype="<u4").tobytes() for w in words]


def test_word_vocabulary_matches_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    assert own.own_split
    texts = odd_texts(1500, 2) + ["e\u0301 x\u0301\u00a0y it's 'tis I'LL .'s 12\u00bd\u00b2 \u0345a ΐ ſ ﬁ", " \u0301a b", "J\u030c J\u030ca =\u0338 \u1100\u1161 </w> a</w> x"]
    for t, ids in zip(texts, own.encode_many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    many = own.encode_many(texts)
    own.prepare(texts)  # all by chunks give the same
    assert [own.encode(t) for t in texts] == many
    own.words.clear()
    own.closes[:] = False  # words one by one give the same
    assert own.encode_many(texts) == many


@pytest.mark.parametrize("small", [False, True])
def test_unigram_matches_library(small):
    from tokenizers import Tokenizer, models, pre_tokenizers

    m = unigram.MARK
    vocabulary = [("<unk>", 0.0), (m, -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), (m + "a", -3.0), ("aa", -2.0), ("aab", -3.0)] if small else unigram.zipf_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, 0, not small))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=m, prepend_scheme="always", split=True)
    own = unigram.UnigramCounter(vocabulary, not small)
    texts = odd_texts(600, 3) + ["".join(RND.choice("aab bcc " + m) for _ in range(RND.randrange(25))) for _ in range(600)]
    own.prepare(texts)
    for t in texts:
        assert own.count(t) == len(library.encode(t).ids), repr(t)


def test_plan_places_everything_once():
    for seed in range(6):
        rnd = random.Random(seed)
        capacity = rnd.choice([1, 7, 64, 512])
        counts = {n: rnd.randrange(1, 60) for n in rnd.sample(range(1, capacity + 1), min(capacity, rnd.randrange(1, 50)))}
        filled, seen = {}, {}
        for n, first, repeats, sequence, offset in packing.plan(counts, capacity):
            for i in range(repeats):
                assert (n, first + i) not in seen
                seen[n, first + i] = (sequence + i, offset)
                filled.setdefault(sequence + i, []).append((offset, n))
        assert {k: sum(1 for n, _ in seen if n == k) for k in counts} == counts
        for parts in filled.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity
        alone = sum(r for _, r in packing.best_fit(counts, capacity))
        assert -(-sum(k * v for k, v in counts.items()) // capacity) <= len(filled) <= 1.01 * alone + 1
    assert packing.plan({}, 8) == []


def test_patterns_of_many_lengths():
    """Over 1000 lengths, of which few fill a sequence: these are found, and pairs completely by their room."""
    capacity = 4096
    counts = {n: 1 for n in range(2050, 3100)} | {1500: 90, 1201: 90, 1395: 90, 901: 7, 902: 7, 903: 7, 1390: 7}
    found = packing.few_piece_patterns(counts, capacity, 8, 0)
    assert found[1500, 1395, 1201] > 80 and all(sum(p) == capacity for p in found)
    rnd = random.Random(3)
    counts = {n: rnd.randrange(1, 9) for n in rnd.sample(range(1, 65), 40)}
    found, rest, want = packing.few_piece_patterns(counts, 64, 2, 5), dict(counts), {}
    for room in range(6):  # by hand: the whole, then each pair from the closest lengths on
        for a in range(64 - room, 0, -1):
            b = 64 - room - a
            times = rest.get(a, 0) if b == 0 else min(rest.get(a, 0), rest.get(b, 0)) if a > b else rest.get(a, 0) // 2 if a == b else 0
            for n in (a, b) if times and b else (a,) if times else ():
                rest[n] -= times
            if times:
                want[(a, b) if b else (a,)] = times
    assert found == want


def test_most_pieces_are_placed_by_fitted_patterns():
    """Also where lengths are many and counts few; the number of sequences stays near best fit's or below."""
    rnd = random.Random(1)
    for low, n, capacity, share in ((1, 3000, 4096, 0.9), (1000, 1500, 4096, 0.6), (1, 49, 512, 0.5)):
        counts = {k: rnd.randrange(1, 60) for k in rnd.sample(range(low, capacity), n)}
        plans = [packing.fitted_fill(counts, capacity, size, capacity // room) for size, room in packing.PLANS]
        chosen, placed = min(plans, key=lambda p: sum(r for _, r in p[0]))
        assert placed >= share * sum(counts.values())
        assert sum(r for _, r in chosen) <= 1.002 * sum(r for _, r in packing.best_fit(counts, capacity))
        assert sum(r * len(p) for p, r in chosen) == sum(counts.values()) and all(sum(p) <= capacity for p, _ in chosen)


def test_fit_is_non_negative_and_lowers_the_error():
    counts = {3: 10, 5: 10, 2: 4, 8: 1}
    patterns = list(packing.few_piece_patterns(counts, 8, 3, 0))
    x = packing.fit_counts(patterns, counts)
    assert min(x) >= 0 and (5, 3) in patterns and x[patterns.index((5, 3))] > 5


def test_lzw_round_trip_and_damage():
    for n in (1, 2, 576, 20_000):
        for size in (2, 4, 8):
            for kind in range(3):
                data = bytes(RND.randrange(1 << size) if kind == 0 else (i // 7) % (1 << size) if kind == 1 else 1 for i in range(n))
                assert gif.lzw_decode(gif.lzw_encode(data, size), size, n).tobytes() == data
    with pytest.raises(ValueError):
        gif.lzw_strings(np.array([1, 300]), 256)


def naive_lzw(codes, clear):
    table, out, previous = {}, b"", None
    for c in codes:
        entry = bytes([c]) if c < clear else table[c] if c in table else previous + previous[:1]
        if previous is not None and len(table) < 4096 - clear - 2:
            table[clear + 2 + len(table)] = previous + entry[:1]
        out += entry
        previous = entry
    return out


def test_lzw_strings_match_a_string_table():
    for seed in range(20):
        rnd = random.Random(seed)
        codes = [rnd.randrange(4)]
        for i in range(1, 300):
            codes.append(rnd.randrange(4) if rnd.random() < 0.4 else 6 + rnd.randrange(i))
        assert gif.lzw_strings(np.array(codes), 4).tobytes() == naive_lzw(codes, 4)


def deferred_lzw(data, size):
    """An encoder that never clears: it goes on with the full table."""
    clear = 1 << size
    table, codes, prefix = {}, [], data[:1]
    for b in data[1:]:
        longer = prefix + bytes([b])
        if len(longer) > 1 and longer in table:
            prefix = longer
            continue
        codes.append(table[prefix] if len(prefix) > 1 else prefix[0])
        if len(table) < 4096 - clear - 2:
            table[longer] = clear + 2 + len(table)
        prefix = bytes([b])
    codes.append(table[prefix] if len(prefix) > 1 else prefix[0])
    codes.append(clear + 1)
    bits, at = clear, size + 1
    for c, w in zip(codes, gif.code_widths(len(codes), size), strict=True):
        bits |= c << at
        at += int(w)
    return bits.to_bytes((at + 7) // 8, "little"), len(codes)


@pytest.mark.parametrize("size", [2, 8])
def test_lzw_deferred_clear(size):
    for n in (3_000, 40_000, 150_000):
        data = bytes(RND.randrange(1 << size) if RND.random() < 0.5 else i % 3 for i in range(n))
        stream, codes = deferred_lzw(data, size)
        assert n < 150_000 or codes > 4096 + (1 << 14)
        assert gif.lzw_decode(stream, size, n).tobytes() == data
        again = gif.lzw_decode(stream, size, n + 1)
        assert again.tobytes() == data


def test_gif_composition_rules():
    colours = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    frames = [
        {"pixels": bytes([0] * 16), "width": 4, "delay": 5, "disposal": 1},
        {"pixels": bytes([1, 2, 1, 2]), "width": 2, "left": 1, "top": 1, "transparent": 2, "disposal": 3, "delay": 7},
        {"pixels": bytes([2] * 4), "width": 2, "disposal": 2},
        {"pixels": bytes(range(4)) * 2, "width": 1, "palette": bytes([1, 1, 1] * 4), "interlaced": True, "left": 3, "top": 0, "disposal": 0},
    ]
    frames[3]["pixels"] = bytes([0, 1, 2, 3])
    got = gif.read_gif(gif.write_gif(4, 4, frames, colours), screens=True)["frames"]
    assert [f["pixels"] for f in got] == [f["pixels"] for f in frames]
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    assert tuple(got[1]["screen"][1, 1]) == green and tuple(got[1]["screen"][1, 2]) == red
    assert tuple(got[2]["screen"][1, 1]) == blue and tuple(got[2]["screen"][1, 2]) == red  # the second frame is undone
    assert tuple(got[3]["screen"][0, 0]) == (0, 0, 0, 0) and tuple(got[3]["screen"][2, 3]) == (1, 1, 1, 255)
    rows = gif.frame_rows({"frames": got})
    assert [r["at_ms"] for r in rows] == [0, 50, 120, 120] and sum(rows[0]["histogram"]) == 16
    bomb = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b";"
    for damaged in (bomb, b"", b"GIF89a", gif.write_gif(4, 4, frames, colours)[:60]):
        with pytest.raises((ValueError, IndexError, struct.error)):
            gif.read_gif(damaged)


def brute_shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def test_shingles_match_brute_force():
    texts = odd_texts(300, 4) + ["a b c a b c", "A B\tc\x0bd", "a", "a b"]
    for k in (1, 3, 5):
        own, want = hashing.shingle_sets(texts, k), [brute_shingles(t, k) for t in texts]
        assert [len(s) for s in own] == [len(w) for w in want]
        for i in range(0, len(texts), 7):
            for j in range(1, len(texts), 11):
                assert len(np.intersect1d(own[i], own[j])) == len(want[i] & want[j])


def family(words, copies, changes, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(changes):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def brute_components(sets, percent):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = []
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.append((j, i))
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], links


def near_copies():
    base = [f"w{i}" for i in range(120)]
    texts = [t for k in range(1, 5) for t in family(base, 15, k, k)] + [" ".join(base)] * 3
    texts += [t for s in range(12) for t in family([f"v{s}_{i}" for i in range(40 + s)], 4, 1, s)]
    return texts + ["", "one", "one", "one two", " \t"]


def test_bands_find_every_link_and_blocks_are_exact():
    texts = near_copies()
    want, links = brute_components([brute_shingles(t, 3) for t in texts], 85)
    sets = hashing.shingle_sets(texts, 3)
    keys = neardup.band_keys(neardup.sketches(sets, neardup.bands_for(0.85) * neardup.ROWS), neardup.ROWS)
    assert len(links) > 300 and all((keys[i] == keys[j]).any() for i, j in links)
    some = [i for i in range(len(texts)) if len(sets[i])]
    assert neardup.search_block(some, [sets[i] for i in some], 85) == [want[i] for i in some]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 5, 50, 2000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate((a[: n // 2], rng.integers(0, 1 << 63, n - n // 2).astype(np.uint64)))
        s = neardup.sketches([a, b], 240)
        assert (s != np.iinfo(np.uint64).max).all()
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - real) < 0.13


def test_order_minhash():
    text = "".join(RND.choice("abcd ") for _ in range(3000))
    swapped = text[1500:] + text[:1500]
    a = ordermin.signature(text)
    assert ordermin.likeness(a, ordermin.signature(text)) == 1
    near = ordermin.likeness(a, ordermin.signature(text[:700] + "xyz" + text[700:]))
    moved = ordermin.likeness(a, ordermin.signature(swapped))
    assert near > 0.8 > moved > 0.1  # the same k-mers, half the order
    assert ordermin.likeness(a, ordermin.signature(text[::-1])) < 0.1
    for t in ("abcabcabcabcabcabcabc", "aaaa" * 10, "ab", "x"):
        own, n, seen, want = ordermin.numbered_kmers(t), min(12, len(t)), {}, []
        for i in range(len(t) - n + 1):
            k = t[i : i + n]
            want.append((k, seen.get(k, 0)))
            seen[k] = seen.get(k, 0) + 1
        assert len(set(own.tolist())) == len(set(want)) == len(own)
    assert ordermin.edited_text("abcde", "xy") == "abcxy" and ordermin.edited_text("abcd", "z") == "abz" and ordermin.edited_text("", "z") == ""


M64 = (1 << 64) - 1


def brute_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def brute_constant(i, seed):
    return brute_mix((i + 1) * 0x9E3779B97F4A7C15 + seed & M64)


def brute_order_minhash(text, k=12, size=2, entries=64):
    """Signature by plain Python: numbered k-mers hashed one by one, sorted for every hash function."""
    n = min(k, len(text))
    seen, base = {}, []
    for i in range(len(text) - n + 1 if text else 0):
        gram = text[i : i + n]
        number = seen[gram] = seen.get(gram, -1) + 1
        rolled = brute_mix(sum((ord(c) + 1) * (brute_constant(j, 41) | 1) for j, c in enumerate(gram)) & M64)
        base.append((rolled if number == 0 else brute_mix(rolled + number * 0x9E3779B97F4A7C15 & M64)) >> 32)
    if not base:
        return [0] * entries
    out = []
    for e in range(entries):
        rank = [(b * (brute_constant(e, 43) | 1) + brute_constant(e, 53)) & M64 for b in base]
        places = sorted(sorted(range(len(base)), key=lambda i: (rank[i], i))[:size])
        total = sum(brute_mix(base[p]) * (brute_constant(j, 47) | 1) for j, p in enumerate(places))
        out.append(brute_mix(total + len(places) & M64) >> 48)
    return out


def test_order_minhash_signature_matches_brute_force(monkeypatch):
    monkeypatch.setattr(ordermin, "SLICE", 50)  # several slices
    for t in ["", "a", "abcdefghijklm", "ab" * 40, "naïve \U0001f600 text " * 9, "".join(RND.choice("abc ") for _ in range(300)), "x" * 200]:
        assert ordermin.signature(t).tolist() == brute_order_minhash(t)


def brute_places(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    out = []
    for phrase in licences.BASE:
        p = phrase.split()
        out += [i for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_licence_places_match_brute_force():
    pieces = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "é", "x1", ".", "\n", "ccby", "cc by cc by"]
    for _ in range(400):
        text = RND.choice([" ", "-", ", "]).join(RND.choice(pieces) for _ in range(RND.randrange(14)))
        got = licences.scan(text)
        assert (got["n_words"], sorted(got["places"])) == brute_places(text)
    assert licences.scan("") == {"n_words": 0, "places": [], "base_labels": [], "labels": [], "expressions": [], "score": 1.0}


def test_licence_expressions():
    assert licences.to_postfix("mit or apache-2.0 and gpl-2.0 with llvm-exception") == ["mit", "apache-2.0", "gpl-2.0", "llvm-exception", "with", "and", "or"]
    assert licences.to_postfix("(mit or apache-2.0) and isc. trailing words") == ["mit", "apache-2.0", "or", "isc", "and"]
    assert licences.to_postfix("mit and") == licences.to_postfix("mit or (") == licences.to_postfix("mit with (a or b)") == ["mit"]
    assert licences.to_postfix("") == licences.to_postfix("and mit") == licences.to_postfix("see the file") == licences.to_postfix("mit-ish") == []
    assert licences.to_postfix("mit and (isc or") == ["mit", "isc", "and"] and licences.to_postfix("licenseref-own or gpl-3.0-or-later") == ["licenseref-own", "gpl-3.0-or-later", "or"]
    got = licences.scan("# SPDX-License-Identifier: (MIT OR GPL-3.0-only)\ncode")
    assert got["labels"] == ["gpl-3.0-only", "mit"] and got["score"] == 1.0
    assert licences.scan("SPDX-License-Identifier: see the file")["labels"] == [] and licences.scan('{"license": "BSD-3-Clause"}')["labels"] == ["bsd-3-clause"]


def brute_expression(tokens):
    """Recursive descent: (labels, freedom) of a whole expression."""

    def unit():
        if tokens[0] == "(":
            tokens.pop(0)
            out = level(0)
            tokens.pop(0)
            return out
        name = tokens.pop(0)
        if tokens and tokens[0] == "with":
            tokens.pop(0)
            return {f"{name} with {tokens.pop(0)}"}, licences.freedom(name)
        return {name}, licences.freedom(name)

    def level(k):
        if k == 2:
            return unit()
        labels, free = level(k + 1)
        while tokens and tokens[0] == ("or", "and")[k]:
            tokens.pop(0)
            other, f = level(k + 1)
            labels, free = labels | other, (max, min)[k](free, f)
        return labels, free

    return level(0)


def random_expression(depth=0):
    kind = RND.randrange(5 if depth < 3 else 2)
    if kind == 0:
        return RND.choice(["gpl-2.0", "gpl-3.0-or-later"]) + " with " + RND.choice(["llvm-exception", "classpath-exception-2.0"])
    if kind == 1:
        return RND.choice(["mit", "apache-2.0", "cc-by-nc-4.0", "licenseref-x", "mpl-2.0+"])
    if kind == 2:
        return f"({random_expression(depth + 1)})"
    return f"{random_expression(depth + 1)} {RND.choice(['and', 'or'])} {random_expression(depth + 1)}"


def test_licence_labels_and_scores_match_brute_force():
    phrases = licences.NOTICES | licences.BASE
    for _ in range(300):
        notices = [RND.choice(list(phrases)) for _ in range(RND.randrange(4))]
        expressions = [random_expression() for _ in range(RND.randrange(3))]
        parts = [n.title() for n in notices] + [f"SPDX-License-Identifier: {e.upper()}\n" for e in expressions] + ["words between", "license", "the"]
        RND.shuffle(parts)
        text = " .\n".join(parts)
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
        labels = {label for p, label in phrases.items() if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
        scores = [licences.freedom(x) for x in labels]
        for e in expressions:
            named, free = brute_expression(re.findall(r"[()]|[^\s()]+", e))
            labels |= named
            scores.append(free)
        got = licences.scan(text)
        assert got["labels"] == sorted(labels) and got["score"] == min(scores, default=1.0)


def test_licence_hits_take_linear_time():
    import time

    took = []
    for n in (100_000, 400_000):
        begin = time.perf_counter()
        assert len(licences.scan("cc by x. " * n)["places"]) == n and licences.scan("license: mit\n" * n)["labels"] == ["mit"]
        took.append(time.perf_counter() - begin)
    assert took[1] < 10 * took[0]


def test_warc_records_and_keys():
    payload = "é\r\n\r\nWARC/1.1".encode()
    raw = warc.build_record("response", 7, "http://a.b/\r\nX: y", payload, hashlib.sha1(payload).digest(), None, "2026-01-01T00:00:00Z")
    record = warc.parse_record(raw)
    assert record["payload"] == payload and warc.page_of(record["headers"]["warc-record-id"]) == 7
    revisit = warc.parse_record(warc.build_record("revisit", 1, None, payload, hashlib.sha1(payload).digest(), 7, "d"))
    assert revisit["payload"] == b"" and warc.page_of(revisit["headers"]["warc-refers-to"]) == 7
    assert warc.url_key("http://www.Example.com:80/A?b#c") == "com,example)/a?b"
    assert warc.url_key("https://m.x.net:8080") == "net,x,m:8080)/"
    for odd in (None, "", "http://[bad", "a\nb c"):
        assert "\n" not in warc.url_key(odd) and " " not in warc.url_key(odd)


def test_gram_codes_pad_each_text():
    texts = ["ab", "", "xyz\U0001f600"]
    codes, counts = quality.gram_codes(texts)
    assert counts.tolist() == [2, 0, 4]
    single, _ = quality.gram_codes(["xyz\U0001f600"])
    assert codes[2:].tolist() == single.tolist()
    assert codes[0] & 4095 == ord("a") and codes[0] >> 12 & 4095 == quality.START
