"""Decontamination, license scans, BPE, fingerprints: against brute force, the library, and awkward rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe, common, decontaminate, licenses, piecewise

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(fold(text))


# ---- words ------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB1é日 .\n\t*_", max_size=30), max_size=6))
def test_words_and_grams(texts):
    data, offsets = common.as_bytes(pa.array(texts, pa.string()))
    got = common.Words(data, offsets, common.ALNUM)
    want = [w for t in texts for w in words(t)]
    assert [data[s:e].tobytes().lower().decode() for s, e in zip(got.start, got.end, strict=True)] == want
    assert got.count.tolist() == [len(words(t)) for t in texts]
    by = {}
    for h, w in zip(got.hash.tolist(), want, strict=True):
        assert by.setdefault(h, w) == w
    at, hashes = got.grams(2)
    pairs = [(i, tuple(ws[k : k + 2])) for i, ws in enumerate(map(words, texts)) for k in range(len(ws) - 1)]
    assert got.doc[at].tolist() == [i for i, _ in pairs]
    assert len(set(hashes.tolist())) == len({p for _, p in pairs})


def test_offsets_of_sliced_and_null_columns():
    column = pa.array(["ab", None, "", "cde"]).slice(1)
    data, offsets = common.as_bytes(column)
    assert data.tobytes() == b"cde" and offsets.tolist() == [0, 0, 0, 3]
    assert list(common.slices(np.array([0, 5, 9, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]


# ---- decontamination --------------------------------------------------------------------------


def hits(text, items, n=13):
    w = words(text)
    mark, found = [False] * len(w), set()
    for item, t in items:
        iw = words(t)
        size = min(n, len(iw))
        grams = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)} if iw else set()
        for k in range(len(w) - size + 1):
            if size and tuple(w[k : k + size]) in grams:
                mark[k : k + size] = [True] * size
                if item is not None:
                    found.add(str(item))
    return len(w), sum(mark), sorted(found)


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(3)
    long = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(20)) for _ in range(8)]
    rows = [*enumerate(long), (20, "Only four words, really"), (21, ""), (22, None), (None, "no id at all"), (20, long[0]), (23, "!!!")]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


def test_hits_match_brute_force_in_any_number_of_blocks(spark, bench):
    table, items = bench
    rng = random.Random(5)
    texts = []
    for i in range(40):
        parts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(0, 30)))]
        if i % 2:
            parts.append(rng.choice([t for _, t in items if t]).upper())
        parts.append("tail; words")
        texts.append((i, "  ".join(parts)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (1 << 20, 11):
        got = {r["doc_id"]: r["contamination"] for r in decontaminate.contamination(docs, table, block_windows=block).collect()}
        for i, t in texts:
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == hits(t, items), (i, block)


def test_one_block_of_windows_lives_at_a_time(spark, bench, monkeypatch):
    """Each pass is materialised with its block before the next block is collected, and no block is much over the bound."""
    made, done = [], []
    whole = decontaminate.checkpoint
    table_of = decontaminate.WindowTable
    monkeypatch.setattr(decontaminate, "WindowTable", lambda rows: made.append((len(rows), len(done))) or table_of(rows))
    monkeypatch.setattr(decontaminate, "checkpoint", lambda df: (whole(df), done.append(1))[0])
    found = decontaminate.contamination(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), bench[0], block_windows=12)
    assert len(made) > 3 and [d for _, d in made] == list(range(1, len(made) + 1)) and max(n for n, _ in made) <= 24
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_result_columns_do_not_clash(spark, bench):
    docs = spark.createDataFrame([(1, "a b c", 7)], "doc_id long, text string, contamination int")
    assert decontaminate.contamination(docs, bench[0]).columns == ["doc_id", "text", "contamination", "_contamination"]
    assert decontaminate.decontaminate(docs, bench[0]).collect() == docs.collect()
    assert bpe.encode_documents(docs.withColumnRenamed("contamination", "ids")).columns == ["doc_id", "ids", "_ids"]


def test_spans_are_cut_and_documents_dropped(spark, bench):
    table, items = bench
    item = items[2][1]
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}! After é."), (2, "Clean text."), (3, None)], "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, table, "spans").collect()}
    assert cut == {1: "Before, ! After é.", 2: "Clean text.", 3: None}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, table).collect()} == {2, 3}
    with pytest.raises(ValueError, match="mode"):
        decontaminate.decontaminate(docs, table, "half")


def test_the_ratio_is_one_in_twenty(spark, bench):
    table, items = bench
    item = items[1][1]
    filler = [f"q{i}" for i in range(380)]
    docs = spark.createDataFrame([(1, " ".join([item, *filler])), (2, " ".join([item, *filler, "one"]))], "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, table).collect()} == {2}


def test_decontamination_of_awkward_rows(spark, awkward, none, bench):
    table, _ = bench
    got = decontaminate.contamination(awkward, table)
    assert got.count() == awkward.count() and got.columns == [*awkward.columns, "contamination"]
    assert decontaminate.decontaminate(awkward, table, "spans").columns == awkward.columns
    assert decontaminate.contamination(none, table).count() == 0
    assert decontaminate.contamination(awkward, table.limit(0)).filter("contamination.n_hit > 0").count() == 0


# ---- license scans ----------------------------------------------------------------------------


def plain_scan(text):
    """The same decisions from all pairs of a text position and a template position."""
    w = words(text)
    places, base, more, best = [], set(), set(), 0.0
    for _, label, kind, k, t in licenses.templates():
        votes = {}
        for i in range(len(t) - k + 1):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == t[i : i + k]:
                    votes.setdefault(j - i, set()).add(i)
        if kind == "phrase":
            starts = [d for d, at in votes.items() if len(at) == len(t) - k + 1]
            places += starts
            base |= {label} if starts else set()
            continue
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= licenses.GAP:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            covered = {i + x for d in g for i in votes[d] for x in range(k)}
            ends = [d + i for d in g for i in votes[d]]
            if len(covered) / len(t) >= licenses.COVERED and max(ends) + k - min(ends) <= 2 * len(t):
                more.add(label)
                best = max(best, len(covered) / len(t))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else best


def planted(rng, kind):
    """A notice between other words, as it is, shifted, cut at either end, or with words changed, added and lost."""
    label = rng.choice(sorted(licenses.NOTICES))
    own = licenses.NOTICES[label].split()
    if kind == "cut":
        n = int(len(own) * 0.75)
        own = own[:n] if rng.random() < 0.5 else own[-n:]
    if kind == "edited":
        for _ in range(max(1, len(own) // 20)):
            i = rng.randrange(len(own))
            own[i : i + 1] = rng.choice([[], ["other"], [own[i], "more"]])
    other = [rng.choice(["the", "software", "of", "license", "copy", "any", "this", "is", "to"]) for _ in range(rng.randrange(0, 40))]
    at = rng.randrange(len(other) + 1)
    return label, " ".join([*other[:at], *own, *other[at:]])


@pytest.mark.parametrize("seed", range(3))
def test_scan_matches_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, planted(rng, rng.choice(["whole", "cut", "edited"]))[1].title()) for i in range(40)] + [(90, None), (91, ""), (92, "mit license, MIT license")]
    got = {r["doc_id"]: tuple(r)[1:8] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = plain_scan(text)
        assert got[i][:6] == want[:6] and got[i][6] == pytest.approx(want[6]), (i, text)


def test_planted_notices_are_found(spark):
    """Recall by kind of edit: every whole, shifted and cut notice; nine in ten with one word in twenty changed."""
    rng = random.Random(8)
    made = {(kind, i): planted(rng, kind) for kind in ("whole", "cut", "edited") for i in range(100)}
    rows = [(n, text) for n, (_, text) in enumerate(made.values())]
    found = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = {}
    for n, ((kind, _), (label, _)) in enumerate(made.items()):
        right.setdefault(kind, []).append(label in found[n])
    assert all(right["whole"]) and all(right["cut"]) and sum(right["edited"]) >= 90
    other = [(i, " ".join(rng.choice(licenses.NOTICES["mit-warranty"].split()) for _ in range(300))) for i in range(20)]
    assert all(r["labels"] == "" for r in licenses.scan(spark.createDataFrame(other, "doc_id long, text string")).collect())


def test_phrases(spark):
    rows = [
        (1, "The MIT  License; apache-license mit license"),
        (2, "general public license general public licensed"),
        (3, "x" * 100_000 + " mit license"),
        (6, None),
        (7, "mit licensed"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 1, 5, "apache,mit")
    assert (got[2]["n_base"], got[2]["base_labels"], got[2]["score"]) == (1, "gpl", 1.0)
    assert (got[3]["first_word"], got[3]["n_words"]) == (1, 3)
    assert (got[6]["n_words"], got[6]["n_base"], got[6]["first_word"], got[6]["labels"], got[6]["score"]) == (0, 0, None, "", 0.0)
    assert got[7]["n_base"] == 0


def test_license_scan_of_awkward_rows(awkward, none):
    got = licenses.scan(awkward).collect()
    assert len(got) == awkward.count() and [r["base_labels"] for r in got if r["doc_id"] == 7] == ["mit"]
    assert licenses.scan(none).count() == 0


def test_template_grams_are_few():
    assert len(licenses.gram_rows()) < 2000


# ---- BPE --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    return bpe.loaded(bpe.vocabulary_text())


PARTS = ["a", "aa", "the", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "中", "1", "½", "!", "...", "'s", "'ll", "'", "<|endoftext|>", "<|", "😀", "​", "\x00", "ed", "er", "A"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(alphabet=st.characters(min_codepoint=0, max_codepoint=0x52F), max_size=4)), max_size=20))
def test_encoding_equals_the_library(library, own, parts):
    text = "".join(parts)
    ids = library.encode(text, add_special_tokens=False).ids
    packed = own.encode([text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert own.decode(packed).decode() == library.decode(ids, skip_special_tokens=False) == text


def test_merging_and_proposals_agree_on_all_short_words(own):
    rng = random.Random(7)
    texts = {"".join(rng.choice("thesinrdoa") for _ in range(rng.randrange(1, 12))) for _ in range(3000)}
    own.cache.clear()
    own.learn(texts)
    assert all(np.frombuffer(own.cache[t], "<u4").tolist() == own.merge(t.encode()) for t in texts)
    failed = sum(own.propose(t.encode()) != own.merge(t.encode()) for t in texts)
    assert 0 < failed < len(texts)  # both ways are taken


def test_short_words_are_merged_together(library, own, monkeypatch):
    """Words of all lengths, at the edges of the matrices too, get the library's ids; none of 64 bytes or less is merged by itself."""
    rng = random.Random(9)
    texts = {"".join(rng.choice(letters) for _ in range(n)) for n in range(1, 65) for letters in ("aab", "thesinrdoa", "xq") for _ in range(8)}
    alone = []
    monkeypatch.setattr(own, "cache", {})
    monkeypatch.setattr(own, "merge", lambda word: alone.append(word) or [0])
    monkeypatch.setattr(bpe, "MATRIX_WORDS", 100)
    own.learn(texts)
    assert not alone and all(np.frombuffer(own.cache[t], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)
    own.learn({"x" * 65})
    assert alone == [b"x" * 65]
    monkeypatch.setattr(own, "of_byte", np.where(np.arange(256) == ord("q"), -1, own.of_byte))
    with pytest.raises(KeyError):
        own.merge_all([b"xxqxq"], 8)


def test_a_full_cache_keeps_the_words_at_hand(own, monkeypatch):
    monkeypatch.setattr(own, "cache", {})
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own.encode(["one two three four five"])
    learned = []
    monkeypatch.setattr(own, "learn", lambda words: learned.extend(sorted(words)) or own.cache.update(dict.fromkeys(words, b"")))
    own.encode(["one two six"])
    assert learned == [" six"] and sorted(own.cache) == [" six", " two", "one"]


def test_very_long_words(library, own):
    for text in ("a" * 3000, "ab" * 2000, "thethe" * 900, " " * 999 + "x"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_letters_of_all_of_unicode(library, own):
    """Each assigned or unassigned character beside letters, digits, signs, spaces and apostrophes is cut as in the library."""
    step = [c for c in [*range(0x3100), *range(0x3100, 0x33480, 37), *range(0xE0000, 0xE0100)] if not 0xD800 <= c < 0xF900]
    new = [0x558, 0x58B, 0x88F, 0xC5C, 0xCDC, 0x208F]
    texts = [t for c in map(chr, step + new) for t in ("a " + c, "1" + c + "1", c + "'s " + c + c, "!" + c + "  \n" + c)]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


def test_encode_and_decode_tables(awkward, none):
    tokens = bpe.encode_documents(awkward)
    assert tokens.columns == [*[c for c in awkward.columns if c != "text"], "ids"]
    back = sorted(r["text"] for r in bpe.decode_ids(tokens).select("text").collect())
    assert back == sorted(r["text"] or "" for r in awkward.select("text").collect())
    rows = bpe.round_trip(awkward).collect()
    assert len(rows) == awkward.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows if r["doc_id"] in (3, 4)} == {(0, empty, empty)}
    assert bpe.round_trip(none).count() == 0 and bpe.encode_documents(none).count() == 0


# ---- fingerprints -----------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=64), st.binary(max_size=64)), max_size=8), st.integers(0, 3))
def test_edit_distance(pairs, cut):
    a, b = [bytes(c % 5 + 65 for c in x) for x, _ in pairs], [bytes(c % 5 + 65 for c in (x[cut:] if i % 2 else y)) for i, (x, y) in enumerate(pairs)]
    assert piecewise.edit_distances(a, b).tolist() == [distance(x, y) for x, y in zip(a, b, strict=True)]


def one(text):
    return piecewise._texts([text])[0]


def test_fingerprint_of_a_text_does_not_depend_on_its_neighbours():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé \n") for _ in range(n)) for n in (0, 1, 5, 40, 900, 5000)]
    assert piecewise._texts(texts) == [one(t) for t in texts]
    assert all(len(s) <= piecewise.LETTERS for t in texts for s in one(t).split(":")[1:])


def test_likeness():
    rng = random.Random(8)
    text = " ".join(f"{rng.choice('abcdefg')}{rng.randrange(99)}" for _ in range(900))
    other = " ".join(f"{rng.choice('hijklmn')}{rng.randrange(99)}" for _ in range(900))
    near, far = piecewise.likeness([one(text), one(text)], [one(piecewise.edited(text, other)), one(other)])
    assert near > 0.5 > 0.3 > far
    assert piecewise.likeness([one(text), one("")], [one(text), one("")]).tolist() == [1.0, 1.0]
    assert piecewise.likeness([one("")], [one(text)]).tolist() == [0.0]


def repeated(rng):
    """A text of one line that comes again and again, or of a few lines in any order, and other words in between."""
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(8, 90))) + "\n" for _ in range(rng.choice([1, 1, 2, 4]))]
    return "".join(rng.choice(lines) if rng.random() < 0.97 else f"{rng.randrange(10**6)} " for _ in range(rng.randrange(30, 300)))


def test_edited_texts_of_repeated_lines_stay_alike():
    rng = random.Random(12)
    texts = [repeated(rng) for _ in range(120)] + ["a" * 5000, "ab" * 900]
    other = " ".join(f"{rng.choice('hijklmn')}{rng.randrange(99)}" for _ in range(9000))
    near = piecewise.likeness([one(t) for t in texts], [one(piecewise.edited(t, other)) for t in texts])
    assert near.min() > 0.3 and np.median(near) > 0.6


def test_letters_spread_over_the_whole_text():
    """No letter covers a great part of a text, so a change of any eighth of it shows, and a like beginning does not hide a different rest."""
    rng = random.Random(3)
    texts = [repeated(rng) for _ in range(80)] + ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(400, 9000))) for _ in range(80)]
    for text in texts:
        n = len(text)
        for p in range(0, n - n // 8, max(1, n // 5)):
            changed = text[:p] + "".join(rng.choice("uvwxyz") for _ in range(n // 8)) + text[p + n // 8 :]
            assert piecewise.likeness([one(text)], [one(changed)])[0] < 0.98
        data, offsets = common.as_bytes(pa.array([text]))
        level, *signatures = one(text).split(":")
        closed = piecewise.closing_levels(piecewise.context_hashes(data, offsets))
        for up, signature in enumerate(signatures):
            ends = np.flatnonzero(closed >= int(level) + up)
            assert len(signature) == len(ends) + (ends[-1] + 1 < len(data))
    line = "this line stands here many times, one after the other\n" * 300
    rest = ["".join(rng.choice(x) for _ in range(len(line) * 3)) for x in ("abcdef", "uvwxyz")]
    assert piecewise.likeness([one(line + rest[0])], [one(line + rest[1])])[0] < 0.5


def test_neighbours_match_a_plain_order(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-1000, 1000), "".join(rng.choice("abé日 ") for _ in range(rng.randrange(0, 90)))) for _ in range(150)] + [(2000, None)]
    rows = list(dict(rows).items())
    ordered = sorted((i, t or "") for i, t in rows)
    got = {r["doc_id"]: r for r in piecewise.compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=7).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        changed = piecewise.edited(t, after)
        assert (got[i]["n_chars"], got[i]["edited_sha256"], got[i]["fingerprint"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), one(t))
        assert got[i]["edited_fingerprint"] == one(changed) and got[i]["near_next"] == piecewise.likeness([one(t)], [one(after)])[0]


def test_neighbours_of_awkward_rows(spark, awkward, none):
    got = piecewise.compare_neighbours(awkward).collect()
    assert len(got) == awkward.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert piecewise.compare_neighbours(none).count() == 0
    alone = piecewise.compare_neighbours(awkward.filter("doc_id = 7")).first()
    assert alone["near_next"] == 1.0
    assert piecewise.fingerprint_documents(awkward).count() == awkward.count()
