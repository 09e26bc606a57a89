"""The operators' cores against brute force, without Spark."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from prosestruct.llm import ann, jaccard, licenses, packing, quality_classifier, quality_rules, token_counts, url_filter
from prosestruct.llm.queries import tokenizer_path
from prosestruct.llm.word_bpe import WordBpe

WORDS = ["the", "The", "été", "Straße,", "don't", "x1y22", "naïve...", "##", "日本語", "áb", "İstanbul", "foo<|endoftext|>", "e" * 90, "ПРИВЕТ!", "thinganaingther."]


def some_text(draw: random.Random, n: int) -> str:
    made = lambda: "".join(draw.choice("abcdeèéßÖTh.,!|") for _ in range(draw.randint(1, 14)))
    return "".join(draw.choice(WORDS) + draw.choice([" ", "\n", "\t "]) if draw.random() < 0.4 else made() + draw.choice([" ", "  "]) for _ in range(n))


def test_word_bpe_gives_the_librarys_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    draw = random.Random(3)
    texts = ["", " \n", "foo <|endoftext|> bar", "a<|startoftext|>b", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", *(some_text(draw, 300) for _ in range(40))]
    got = WordBpe(tokenizer_path("word_bpe_49k.json"))(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_bpe_splits_few_texts_at_a_time(monkeypatch):
    """Words in hand grow with neither the texts of a batch nor the words met so far; ids are the same."""
    import tracemalloc

    from prosestruct.llm import word_bpe

    encode, draw = WordBpe(tokenizer_path("word_bpe_49k.json")), random.Random(5)
    texts = [" ".join(draw.choices(WORDS[:10], k=4000)) for _ in range(200)]
    whole = encode(texts)
    held = 2 * sum(map(len, whole))
    tracemalloc.start()
    assert encode(texts) == whole
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < held, (peak, held)
    monkeypatch.setattr(word_bpe, "AT_A_TIME", 50)
    monkeypatch.setattr(word_bpe, "MAX_KEPT", 20)
    mixed = ["", *(some_text(draw, n) for n in (1, 300, 2, 2, 0, 40)), "", "x"]
    assert encode(mixed) == [encode([text])[0] for text in mixed] and encode([]) == []
    assert len(encode.words) < 400


def test_tasks_give_memory_back(monkeypatch):
    """Workers outlive tasks: each task of an Arrow map ends with what it freed given to the system, also if it fails or is cut short."""
    import pyarrow as pa

    from prosestruct.llm import common

    class Frame:
        def mapInArrow(self, run, ddl):  # noqa: N802  Spark's name
            return run

    calls = []
    schema = pa.schema([("x", pa.int64())])
    monkeypatch.setattr(common, "arrow_schema", lambda df, ddl: schema)
    monkeypatch.setattr(common, "give_back", lambda give_back=getattr(common, "give_back", None): calls.append(give_back()))
    batch = pa.record_batch({"x": pa.array([1, 2])})
    assert [b.to_pydict() for b in common.arrow_map(Frame(), lambda: lambda c: c, "x long")(iter([batch, batch]))] == [{"x": [1, 2]}] * 2 and len(calls) == 1
    with pytest.raises(KeyError):
        list(common.arrow_map(Frame(), lambda: lambda c: {}, "x long")(iter([batch])))
    cut = common.arrow_map(Frame(), lambda: lambda c: c, "x long")(iter([batch, batch]))
    next(cut)
    cut.close()
    assert len(calls) == 3


def test_trie_counts_match_plain_viterbi():
    pieces = token_counts.load_pieces(tokenizer_path("piece_bpe_32k.model"))
    unknown = min(pieces.values()) - token_counts.UNKNOWN_PENALTY

    def plain(word):
        s = token_counts.MARK + word
        best = [(0.0, 0, 0)]
        for end in range(1, len(s) + 1):
            options = []
            for start in range(end):
                if s[start:end] in pieces:
                    options.append((best[start][0] + pieces[s[start:end]], -start, best[start][1] + 1, best[start][2]))
                elif end - start == 1:
                    options.append((best[start][0] + unknown, -start, best[start][1] + len(s[start].encode()), best[start][2] + 1))
            top = max(options, key=lambda o: (o[0], o[1]))
            best.append((top[0], top[2], top[3]))
        return best[-1][1], best[-1][2], best[-1][0]

    assert all(-30 < s < 0 for s in pieces.values()) and 0.99 < sum(math.exp(s) for s in pieces.values()) < 1.01
    draw = random.Random(4)
    counter = token_counts.TrieCounter(pieces, max_nodes=500)
    for word in {w for _ in range(20) for w in some_text(draw, 30).split()} | {"z" * 130, "☃" * 3}:
        assert counter(word.encode()) == plain(word)


@pytest.mark.parametrize("window, most", [(16, 3), (64, 50)])
def test_packing_is_a_round_trip_without_padding(window, most):
    draw = random.Random(window)
    documents = [(d, np.array([draw.randint(0, 9) for _ in range(draw.choice([1, 3, 9, window - 1, window, 3 * window + 2]))], dtype="<u4").tobytes()) for d in range(300)]
    packer = packing.SumOfSquares(window, most)
    placed = [p for d, ids in documents for p in packer.put(d, ids)] + list(packer.empty())
    pieces, sequences = {}, {}
    for sequence, offset, (d, start, ids, tokens) in placed:
        pieces.setdefault(d, []).append((start, ids))
        sequences.setdefault(sequence, []).append((offset, len(ids) // 4))
        assert tokens == len(dict(documents)[d]) // 4
    assert all(b"".join(x for _, x in sorted(pieces[d])) == ids for d, ids in documents)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0


def test_most_ids_stay_where_they_were_placed():
    """Topping up moves few ids, whatever remains open."""
    draw = random.Random(5)
    for most in (1024, 20):
        packer, total = packing.SumOfSquares(4096, most), 0
        for d in range(3000):
            size = int(draw.lognormvariate(6.3, 1.0)) + 1
            total += size
            list(packer.put(d, b"\0" * 4 * size))
        list(packer.empty())
        assert packer.moved < 0.1 * total


def test_sum_of_squares_level_is_the_least():
    packer, draw = packing.SumOfSquares(20), random.Random(1)
    for _ in range(400):
        size = draw.randint(1, 19)
        counts = packer.counts.copy()

        def total(level, counts=counts, size=size):
            after = counts.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 20
            return int((after**2).sum())

        allowed = [h for h in range(21 - size) if h == 0 or counts[h]]
        level = packer._level(size)
        assert level == max(allowed, key=lambda h: (-total(h), h))
        list(packer.put(0, b"\0" * 4 * size))


def test_quality_rules_base_against_regex():
    draw = random.Random(5)
    texts = [None, "", "a a a a a a a a a a a a", *("\n".join(draw.choice(["x y z w v", "x y", "", " ", "é   ü b", "# | %"]) for _ in range(draw.randint(1, 40))) for _ in range(60))]
    for text in texts:
        own = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", own)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        lines = [x for x in own.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = quality_rules.judge(text)
        assert (got["n_words"], got["word_chars"], got["n_repeat_words"]) == (len(words), sum(map(len, words)), len(repeated))
        assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", own)) and got["n_dup_lines"] == len(lines) - len(set(lines))
        assert got["base_failed"] == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))


def test_quality_rules_against_their_sql():
    import duckdb
    import pyarrow as pa

    from prosestruct.llm.queries import oracle_sql

    draw = random.Random(6)
    bits = ["wow!!", "no??", "a|b", "|", "»", "click here", "TERMS of use", "é", "plain", "word", "end.", "x" * 30, "日本", "\t", "\r", "::", "Lorem ipsum"]
    made = ["\n".join(" ".join(draw.choices(bits if draw.random() < 0.5 else ["w%d" % i for i in range(40)], k=draw.randint(0, 30))) for _ in range(draw.randint(1, 9))) for _ in range(400)]
    texts = [None, "", " \n ", "wow!! yes!! no!! ok!! fine then", *made, *made[:5], "\n".join(["same line again here"] * 4)]
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    duck = duckdb.connect()
    duck.register("documents", table)
    result = duck.execute(oracle_sql()["op3_quality_rules"])
    names = [d[0] for d in result.description]
    want = sorted((dict(zip(names, row, strict=True)) for row in result.fetchall()), key=lambda r: r["doc_id"])
    got = [{"doc_id": i} | quality_rules.judge(text) for i, text in enumerate(texts)]
    assert [{n: r[n] for n in names} for r in got] == want
    assert len({r["kept"] for r in want}) == 2 and quality_rules.judge(texts[3])["n_punctuation"] == 1


def test_quality_rules_keep_prose_and_drop_junk():
    prose = "A quiet river runs past the mill, and boats wait there.\n" * 1 + "Nobody saw the heron leave; the reeds hid it well."
    bars = " | ".join(f"word{i}" for i in range(60))
    assert quality_rules.judge(prose)["kept"]
    junk = quality_rules.judge(prose + "\n" + bars)
    assert not junk["kept"] and junk["n_navigation"] == 1 and junk["cleaned"] == prose


def test_license_places_and_containment():
    text = "X. Released under the MIT\nLicense. apache license, version 2.0; CC BY-NC and under the mit licenses"
    words = licenses.words_of(text)
    found = licenses.places(words, {p.encode(): x for p, x in licenses.BASE.items()})
    brute = sorted((i, x) for p, x in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split())
    assert found == brute and len(found) == 3


def test_license_blocks_against_brute_force():
    """Every block of consecutive words, wherever lines break: labels, best containment and first words."""
    draw = random.Random(2)
    templates = [t for t in licenses.template_words() if len(t[1]) < 25]
    vocabulary = [w for _, words in templates for w in words]
    index = licenses.ContainmentIndex(templates, Counter(draw.choices(vocabulary, k=500)))
    matched = 0
    for _ in range(300):
        words = []
        for _ in range(draw.randint(1, 4)):
            own = list(draw.choice(templates)[1])
            for _ in range(draw.randint(0, 6)):
                own.insert(draw.randrange(len(own) + 1), draw.choice([b"filler", draw.choice(vocabulary)]))
            for _ in range(draw.randint(0, 4)):
                own.pop(draw.randrange(len(own)))
            words += own + [b"other"] * draw.randint(0, 20)
        got = index(words)
        for label, template in templates:
            reach, wanted = math.ceil(len(template) * 1.25), set(template)
            shares = [Fraction(len(wanted & set(words[i : i + reach])), len(wanted)) for i in range(len(words))]
            fits = [i for i, s in enumerate(shares) if s >= licenses.THRESHOLD and words[i] in wanted]
            # Matches begin at the first fitting block behind the one before.
            own, at = [], -1
            for i in fits:
                if i >= at:
                    own.append(i)
                    at = max(k for k in range(i, min(len(words), i + reach)) if words[k] in wanted) + 1
            assert set(own) <= {a for name, a, _ in got if name == label}
            assert not fits or max(shares) <= Fraction(max(s for name, _, s in got if name == label)).limit_denominator(1000)
            matched += len(own)
        assert all(any(set(words[a : a + math.ceil(len(t) * 1.25)]) >= set() and len(set(t) & set(words[a : a + math.ceil(len(t) * 1.25)])) >= 0.8 * len(set(t)) for name, t in templates if name == label) for label, a, _ in got)
    assert matched > 300


def test_scattered_words_are_no_notice_and_wrapped_ones_are():
    index = licenses.ContainmentIndex(licenses.template_words(), {})
    for label, text in licenses.TEMPLATES:
        words = text.split()
        wrapped = "\n * ".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
        assert (label, 0, 1.0) in index(licenses.words_of(wrapped))
        scattered = " filler filler filler ".join(draw for draw in sorted(set(words)))
        assert not index(licenses.words_of(scattered))


def test_ranking_separates_and_handles_one_class():
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.normal(0, 1, (400, 3)), draw.normal(2, 1, (100, 3))])
    good = np.arange(500) < 400
    ranking = quality_classifier.fit(x, good, pairs=5000)
    assert ((ranking.scores(x) >= 0.5) == good).mean() > 0.93
    assert (quality_classifier.fit(x, np.ones(500, bool)).scores(x) == 0.5).all()
    assert len(quality_classifier.features(None)) == len(quality_classifier.features("a b\nc"))


def test_shingles_and_bounds_lose_no_link():
    draw = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    sets = []
    for _ in range(80):
        words = list(base[: draw.choice([40, 118, 120])])
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = f"new{draw.randrange(99)}"
        sets.append(jaccard.Shingler(3)(" ".join(words)))
    sets += [jaccard.Shingler(3)(" ".join(draw.choices(base, k=60))) for _ in range(40)]
    num, den = 80, 100
    order = jaccard.Order(np.sort(sets[0]), np.arange(len(sets[0])) % 7)
    sizes = np.array(list(map(len, sets)))
    sketches = [np.frombuffer(jaccard.sketch(s), np.uint8) for s in sets]
    real = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                real.add((j, i))
                assert jaccard.may_link(sketches[i], sketches[j], len(sets[i]), len(sets[j]), num, den)
                assert set(order.prefix(sets[i], num, den).tolist()) & set(order.prefix(sets[j], num, den).tolist())
    assert len(real) > 100

    for i in (0, 5, 40):
        parts = order.segments(sets[i])
        assert np.array_equal(np.sort(np.concatenate([p for _, p in parts])), sets[i]) and len({f for f, _ in parts}) == len(parts) > 1
        ranks = [(int(order.count(np.array([s]))[0]), int(s), f) for f, p in parts for s in p]
        assert [f for *_, f in sorted(ranks)] == sorted(f for *_, f in ranks)  # fragments follow the order
    for i, j in list(real)[:50]:
        x, y = dict(order.segments(sets[i])), dict(order.segments(sets[j]))
        assert sum(len(np.intersect1d(x[f], y[f])) for f in x.keys() & y.keys()) == len(np.intersect1d(sets[i], sets[j]))
    everyone, labels = np.arange(len(sets)), np.arange(len(sets)) // 2
    left, right = everyone[::2], everyone[1::2]
    found = [tuple(sorted(p)) for a, b in ((left, left), (left, right), (right, right)) for p in jaccard.passing_in_blocks(sketches, sizes, labels, a, b, num, den)]
    assert len(found) == len(set(found)) and {(i, j) for i, j in real if labels[i] != labels[j]} <= set(found)
    assert all(labels[i] != labels[j] for i, j in found)


def test_url_trees_learn_and_are_bounded():
    draw = random.Random(6)
    urls = [(f"https://a{draw.randrange(99)}.example.{t}/{draw.choice(['x', 'yy'])}/{draw.randrange(10 ** 4)}", t) for t in draw.choices(["com", "net"], k=3000)]
    hosts = [u.split("/")[2] for u, _ in urls]
    good = np.array([float(t == "com") for _, t in urls])
    suffixes = url_filter.suffix_counts(hosts[:2000], good[:2000])
    x = np.array([url_filter.lexical(u, h, "/" + u.split("/", 3)[3], suffixes) for (u, _), h in zip(urls, hosts, strict=True)])
    model = url_filter.fit(x[:2000], good[:2000])
    assert ((model.probability(x[2000:]) >= 0.5) == good[2000:]).mean() > 0.99
    assert (url_filter.fit(x[:0], good[:0]).probability(x[:3]) > 0.5).all()


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(20, 50))
    assert np.allclose(np.linalg.norm(ann.Rotation(50, 7, (1,)).turned(x), axis=1), np.linalg.norm(x, axis=1) * 64**1.5)


def test_probes_are_the_largest_sums():
    x = np.random.default_rng(2).normal(size=(5, 6))
    for bits, most in ((3, 8), (6, 10), (7, 128), (10, 40)):
        table = ann.CrossPolytope(6, bits, tables=2)
        got = table.probes(x, most)
        assert (got[:, :, 0] == table.cells(x)).all() or bits > 4  # one rotation: the likeliest cell is the row's own
        for t, rotations in enumerate(table.rotations):
            sums = np.zeros((5, 1))
            for r in rotations:
                sums = (sums[:, :, None] + (r.along(x) * np.sqrt(r.bits))[:, None, :]).reshape(5, -1)
            for own, cells in zip(sums, got[:, t], strict=True):
                assert len(set(cells.tolist())) == min(most, 1 << bits)
                assert np.allclose(own[cells], np.sort(own)[::-1][: len(cells)])


def test_the_scored_share_falls_with_the_rows():
    draw = np.random.default_rng(3)
    shares = []
    for n in (500, 8000):
        x = draw.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = [x[np.argsort(-(x @ x[i]))[1:21]] for i in range(48)]
        index = ann.Index(64, {0: n}, x[:48], near)
        table, probes = index.bands[0]
        shares.append(1 - (1 - probes / 2**table.bits) ** table.tables)
    assert shares[1] < 0.7 * shares[0] and shares[1] < 0.5


def test_bitmaps_never_take_a_shared_shingle_for_one_of_a_single_set():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    batches = [[np.unique(rng.choice(pool, 60)) for _ in range(20)] for _ in range(5)]
    parts = {}
    for sets in batches:
        for part in jaccard.by_range(*np.unique(np.concatenate(sets), return_counts=True)):
            parts.setdefault(part["p"], []).append(part["data"])
    width, bitmaps = 1 << (jaccard.RANGE_BITS - 3), np.zeros((2, 1 << (jaccard.RANGES + jaccard.RANGE_BITS - 3)), dtype=np.uint8)
    for p, data in parts.items():
        bitmaps[:, p * width : (p + 1) * width] = [np.frombuffer(x, np.uint8) for x in jaccard.range_bits(data)]
    values, counts = np.unique(np.concatenate(sum(batches, [])), return_counts=True)
    order, counted = jaccard.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64), *bitmaps), jaccard.is_counted(values)
    assert 0.3 < counted.mean() < 0.7 and not order.alone(values[counts > 1]).any()
    assert order.alone(values[(counts == 1) & counted]).mean() > 0.99
    ranks = order.rank(values)
    assert (ranks[~counted] == 2).all() and (ranks[counted & (counts >= jaccard.COMMON)] == 3).all() and (ranks[counted & (counts > 1)] >= 1).all()
    assert (np.diff(order.rank(order.prefix(values, 1, 2))) >= 0).all()
