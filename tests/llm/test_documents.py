"""Matroska, pieces, PII, language, decontamination, SimHash and toxicity."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from docweave.llm import components as components_module
from docweave.llm import decontaminate, langid, matroska, pieces, pii, simhash, toxicity
from docweave.llm.common import table
from docweave.llm.components import components


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# Matroska


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 192 * 8, 192 * 129, 100_001])
def test_mux_round_trip(size):
    payload = matroska.padded(bytes(k % 251 for k in range(size)))
    stored = matroska.mux(payload)
    media = matroska.parse(stored)
    assert matroska.read_back(stored, media) == payload
    assert [p.timestamp_ns for p in media.packets] == [24_000_000 * k for k in range(len(payload) // 192)]
    assert {at for _, _, at in media.cues} == set(media.clusters)


@pytest.mark.parametrize("kind", [matroska.XIPH, matroska.EBML_LACE])
@pytest.mark.parametrize("sizes", [[3, 700, 254, 255, 1], [128, 127, 126, 1000, 2], [1, 1]])
def test_uneven_laces(kind, sizes):
    body = matroska.lace_header(kind, sizes) + b"x" * sum(sizes)
    assert matroska.lace_sizes(body, 0, len(body), kind)[0] == sizes


def test_unknown_size_and_cut_file():
    stored = matroska.mux(matroska.padded(b"abc" * 500))
    at = stored.index(bytes.fromhex("18538067"))
    _, body, _ = matroska.read_vint(stored, at + 4, len(stored), keep_marker=False)
    live = stored[: at + 4] + b"\x01" + b"\xff" * 7 + stored[body:]
    assert matroska.read_back(live, matroska.parse(live)) == matroska.read_back(stored, matroska.parse(stored))
    with pytest.raises(ValueError):
        matroska.parse(stored[:-5])


def file_of(tracks: bytes, clusters: list[bytes], rest: bytes = b"") -> bytes:
    return matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"matroska")) + matroska.element(
        matroska.SEGMENT, matroska.element(matroska.TRACKS, tracks) + b"".join(matroska.element(matroska.CLUSTER, c) for c in clusters) + rest
    )


def test_lace_times_follow_the_track():
    e, u = matroska.element, matroska.uint
    sound = e(matroska.TRACK_ENTRY, u(matroska.TRACK_NUMBER, 1) + e(matroska.CODEC_ID, b"A_PCM/INT/LIT") + e(0xE1, e(matroska.SAMPLING, b"\x47\x3b\x80\x00") + u(matroska.CHANNELS, 2) + u(matroska.BIT_DEPTH, 16)))
    other = e(matroska.TRACK_ENTRY, u(matroska.TRACK_NUMBER, 2) + e(matroska.CODEC_ID, b"A_OPUS") + u(matroska.DEFAULT_DURATION, 20_000_000))
    bare = e(matroska.TRACK_ENTRY, u(matroska.TRACK_NUMBER, 3) + e(matroska.CODEC_ID, b"V_X"))
    block = lambda n, frames: matroska.block(n, 5, frames, matroska.XIPH, simple=True)
    timed = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x83\x00\x00\x02\x01\x02aabb") + u(matroska.BLOCK_DURATION, 8))
    late = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, b"\x83\x00\x00\x00zz") + e(matroska.REFERENCE_BLOCK, b"\xff"))
    media = matroska.parse(file_of(sound + other + bare, [u(matroska.TIMESTAMP, 100) + block(1, [b"x" * 192, b"y" * 4]) + block(2, [b"p", b"q", b"r"]) + timed + late]))
    ms = [(p.track, p.timestamp_ns / 1e6, p.keyframe) for p in media.packets]
    assert ms == [(1, 105, True), (1, 106, True), (2, 105, True), (2, 125, True), (2, 145, True), (3, 100, True), (3, 104, True), (3, 100, False)]


def test_cues_keep_all_positions_and_nesting_ends(spark):
    e, u = matroska.element, matroska.uint
    place = lambda t, at: e(matroska.CUE_POSITIONS, u(matroska.CUE_TRACK, t) + u(matroska.CUE_CLUSTER, at))
    media = matroska.parse(file_of(b"", [], e(matroska.CUES, e(matroska.CUE_POINT, u(matroska.CUE_TIME, 7) + place(1, 10) + place(2, 20)))))
    assert [(t, n) for t, n, _ in media.cues] == [(7, 1), (7, 2)] and media.cues[1][2] - media.cues[0][2] == 10
    deep = b""
    for _ in range(3000):
        deep = e(matroska.BLOCK_GROUP, deep)
    with pytest.raises(ValueError):
        matroska.parse(deep)
    rows = spark.createDataFrame([(1, bytearray(deep)), (2, bytearray(matroska.mux(matroska.padded(b"a")))), (3, None)], "k bigint, media binary")
    found = matroska.packet_table(rows, "k", "media").collect()
    assert [(r.key, r.error is None) for r in found] == [(1, False), (2, True)]


def test_store_texts(odd, empty):
    assert matroska.store_texts(empty).collect() == []
    rows = matroska.store_texts(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:  # the stored form by its own parts: equal texts, equal values
        assert len({(x.media_sha256, x.feature) for x in rows if x.payload_sha256 == r.payload_sha256}) == 1
    texts = Counter((r.doc_id, r.text) for r in odd.collect())
    for r in rows:
        text = next(t for (i, t) in texts if i == r.doc_id and len((t or "").encode()) == r.n_bytes) or ""
        payload = matroska.padded(text.encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), sha(payload), zlib.crc32(payload[-16:]))
    packets = matroska.packet_table(matroska.mux_column(odd, "doc_id", "text"), "key", "media")
    assert packets.where("error is not null").count() == 0
    assert packets.count() == sum(r.n_packets for r in rows)


# Pieces


def test_pieces_are_lossless_and_reproducible(odd, empty):
    rows = pieces.encode_rows(odd).collect()
    by_id = {}
    for r in rows:
        if r.doc_id is not None:
            assert by_id.setdefault(r.doc_id, r.pieces) == r.pieces  # repeated rows
    assert sorted((r.doc_id or -1, r.decoded or "") for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    again = {r.doc_id: r.pieces for r in pieces.encode_rows(odd.repartition(3)).collect() if r.doc_id is not None}
    assert again == by_id
    assert sorted((r.doc_id or -1, r.text or "") for r in pieces.decode_rows(pieces.encode_rows(odd)).collect()) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    assert pieces.encode_report(empty).collect() == []


def test_draws_next_to_one_stay_in_their_node(monkeypatch):
    """With a node number of 2**19 or so and the largest draw there is, pieces still spell their text."""
    codec = pieces.Codec(pieces.vocabulary(pieces.DEFAULT_MODEL))
    monkeypatch.setattr(pieces, "draws", lambda stream, step: np.full(len(stream), 1 - 2.0**-53))
    text = " ".join(f"word{k} running" for k in range(30_000))
    ids, _ = codec.encode([text], [1])
    assert codec.decode(ids.tolist()) == text


def test_a_vocabulary_without_a_space_piece():
    vocab = [("", 0.0, b) for b in range(256)] + [("a", -1.0, -1)]
    codec = pieces.Codec(vocab)
    ids, _ = codec.encode(["a a ▁ é"], [1])
    assert codec.decode(ids.tolist()) == "a a ▁ é"


def test_sampled_paths_follow_their_weights():
    codec = pieces.Codec(pieces.vocabulary(pieces.DEFAULT_MODEL))
    word, n = " the", 4000
    ids, ends = codec.encode([word] * n, list(range(n)))
    seen = Counter(tuple(x.tolist()) for x in np.split(ids, ends[:-1]))
    weight = {}
    table_ = {codec.bytes_of[i].decode(errors="ignore"): (i, w) for i, w in zip(codec.ids.tolist(), codec.weights.tolist())}

    def paths(at, path, total):
        if at == len(word):
            weight[tuple(path)] = np.exp(total)
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in table_:
                i, w = table_[word[at:end]]
                paths(end, [*path, i], total + w)

    paths(0, [], 0.0)
    z = sum(weight.values())
    assert set(seen) <= set(weight)
    for path, w in weight.items():
        assert abs(seen[path] / n - w / z) < 0.04


# PII


def brute_pii(text):
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


TRICKY = [
    "a@b.c.d@e.f", "x..y@-.-a", "@a.b c@d", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255", "4111-1111 1111-1111 1", "+1 (2) 3-4.5 6789 0", "+12", "aaa@bbb", "9.9.9", "é a@b.c ü 4111111111111111",
    "1234567890123456789012345", "+1-800-555-0199x+44 20 7946 0958", "1 2 3 4 5 6 7 8 9 0 1 2 3", "a@b.c-@d.e", "%@%.com", "a@b.c..d",
]


def test_pii_base_spans(spark, sf):
    for text in [*TRICKY, *(r.text for r in table(spark, sf, "documents").collect())]:
        assert [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE_KINDS] == brute_pii(text), text


def test_pii_added_kinds_and_context():
    good, bad = "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"
    assert [s.kind for s in pii.find(f"iban {good}") if s.kind == "iban"] == ["iban"]
    assert not [s for s in pii.find(f"iban {bad}") if s.kind == "iban"]
    assert [s.kind for s in pii.find("social security 123-45-6789")] == ["ssn"]
    assert pii.find("order 123-45-6789") == []


def test_pii_iban_before_other_tokens():
    bare, spaced, other = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    for iban, tail in [(bare, " EUR 100"), (spaced, " BIC COBADEFF"), (bare, " 12 March"), (bare, ""), (spaced, f" {other}"), (other, " A1 B2 C3 D4 E5 F6")]:
        for head in ("", "pay to ", "AB12 CDEF GHIJ KLMN "):
            found = [(s.start, s.end) for s in pii.find(head + iban + tail) if s.kind == "iban"]
            assert found[0] == (len(head), len(head) + len(iban)) and len(found) == 1 + (tail[1:] == other), head + iban + tail
    # A country without a registered length: the tokens from the longest, here with check digits made for it.
    made = next(f"ZZ{k:02}ABCD12345678901" for k in range(2, 99) if pii.mod97(f"ZZ{k:02}ABCD12345678901"))
    assert [(s.start, s.end) for s in pii.find(f"{made} EUR") if s.kind == "iban"] == [(0, len(made))]
    paid = f"{bare} EUR 100"
    assert pii.redacted(paid, pii.find(paid)) == "[IBAN] EUR 100"


def test_pii_report(odd, empty):
    rows = {r.doc_id: r for r in pii.pii_report(odd).collect()}
    assert (rows[11].n_email, rows[11].n_phone, rows[11].n_card) == (1, 1, 1)
    assert rows[4].base_sha256 == sha(b"") and rows[4].spans == ""
    clean = {r.doc_id: r for r in pii.redact_documents(odd).collect()}
    assert clean[11].text == "mail me at [EMAIL] or [PHONE], card [CARD]" and clean[11].n_chars == len(clean[11].text)
    assert pii.pii_report(empty).collect() == [] and pii.redact_documents(empty).collect() == []


def test_pii_takes_linear_time():
    assert pii.find("a" * 300_000) == [] and pii.find("1" * 300_000) == [] and pii.find("a@" * 100_000) == []


# Decontamination


def brute_hits(words, items, window=13):
    hit, found = set(), set()
    for item_id, item in items:
        n = min(window, len(item))
        for k in range(len(item) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == item[k : k + n]:
                    hit.update(range(p, p + n))
                    found.add(item_id)
    return hit, found


@pytest.mark.parametrize("slots, bits", [(1 << 18, 1 << 24), (16, 64)])
def test_wu_manber_against_brute_force(spark, monkeypatch, slots, bits):
    """Also where every slot and bit is taken many times over: candidates are compared whole."""
    monkeypatch.setattr(decontaminate, "SLOTS", slots)
    monkeypatch.setattr(decontaminate, "BITS", bits)
    rng = np.random.default_rng(5)
    draw = lambda n: [b"ab cd ef".split()[k] for k in rng.integers(0, 3, n)]
    items = [(k, draw(n)) for k, n in enumerate([1, 2, 3, 5, 13, 14, 20, 0])] + [(20 + k, [b"w%d" % j for j in range(30 * k, 30 * k + 30)]) for k in range(20)]
    texts = [(k, draw(n)) for k, n in enumerate((0, 1, 2, 12, 13, 14, 200))] + [(50 + k, [b"w%d" % j for j in range(30 * k + k, 30 * k + k + 25)]) for k in range(19)]
    frame = lambda rows, name: spark.createDataFrame([(i, b" ".join(w).decode()) for i, w in rows], f"{name} bigint, text string")
    found = {r.doc_id: r for r in decontaminate.find_contamination(frame(texts, "doc_id"), frame(items, "item_id")).collect()}
    for i, words in texts:
        hit, want = brute_hits(words, items)
        assert {k for a, b in found[i].spans for k in range(a, b)} == hit and set(found[i]["items"]) == want and found[i].n_words == len(words)


def test_contamination_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "lazy dog while seven wise owls watch from the old oak tree near"), (2, "Emoji"), (3, None), (4, ""), (None, "quick brown")], "item_id bigint, text string")
    found = decontaminate.find_contamination(odd, items).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[1]["items"] == [1] and by_id[12]["items"] == [2] and by_id[4].n_words == 0
    assert [list(s) for s in by_id[1].spans] == [[1, 3], [7, 20]]
    kept = decontaminate.drop_contaminated(odd, items)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8, 9, 10, 11, 13, None}
    assert decontaminate.contamination(empty, items).collect() == []
    assert decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0


# SimHash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {i: i for i, _ in prints}
    top = lambda x: x if root[x] == x else top(root[x])
    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 2:
                lo, hi = sorted((top(i), top(j)))
                root[hi] = lo
    return {i: top(i) for i, _ in prints}


def test_simhash_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    prints = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    root = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicate_report(docs).collect()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints}


def test_links_reach_distance_two_and_no_further(spark):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    prints = base + [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in [rng.integers(0, 64, 2)]] + [b ^ 0b111 for b in base]
    prints = list(dict.fromkeys(prints))
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    distinct = spark.createDataFrame([(p, k) for k, p in signed], "fp bigint, node bigint")
    found = {r.node: r.root for r in components(simhash.links(distinct))[0].collect()}
    assert {k: found.get(k, k) for k, _ in signed} == brute_components(list(enumerate(prints)))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "u bigint, v bigint")
    assert {(r.node, r.root) for r in components(edges)[0].collect()} == {(k, 0) for k in range(1, 201)} | {(501, 500)}


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicate_report(odd).collect()
    assert len(rows) == odd.count()
    blank = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert blank == {4}
    assert simhash.near_duplicate_report(empty).collect() == []
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.component_id for r in rows if r.doc_id is not None})


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return frozenset([" ".join(words[k : k + 5]) for k in range(len(words) - 4)] or ([" ".join(words)] if words else []))


def test_stage_keeps_one_of_each_similar_group(spark, sf):
    """Near copies whose fingerprints are far apart, a large group of them, and passages that many share."""
    rng = np.random.default_rng(3)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    base, passage = draw(300), draw(40)
    edited = [" ".join(w if k not in hit else f"x{c}" for k, w in enumerate(base)) for c in range(60) for hit in [set(rng.integers(0, 300, 5).tolist())]]
    mixed = [" ".join(draw(20) + passage) for _ in range(60)]
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate([*edited, *mixed])], "doc_id bigint, text string"))
    sets = [(r.doc_id, brute_set(r.text)) for r in docs.collect()]
    root = {i: i for i, _ in sets}
    top = lambda x: x if root[x] == x else top(root[x])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                lo, hi = sorted((top(i), top(j)))
                root[hi] = lo
    assert top(177) == top(1) and top(145) == top(6)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: top(i) for i in root}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in root if top(i) == i)


def near_copies(seed, n, edits, count):
    """Texts of n words that differ from one text in so many words each."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 10**6, n)]
    hits = [set(rng.integers(0, n, edits).tolist()) for _ in range(count)]
    return [" ".join(w if k not in hit else f"x{c}" for k, w in enumerate(base)) for c, hit in enumerate(hits)]


def test_stage_meets_near_copies_by_fingerprint_segments(spark):
    """Segments at most a bit apart lead to the least set of the value; nothing else does, and near copies meet that way."""
    texts = [t.encode() for s in range(60) for t in near_copies(s, 200, 1, 2)] + [f"alone {k} {k * k} {k + 7} end".encode() for k in range(60)]
    sets = [simhash.shingle_set(t) for t in texts]
    bits = [simhash.stage_fingerprint(s) for s in sets]
    values = [simhash.segment_values(b).tolist() for b in bits]
    words = [int.from_bytes(np.packbits(b[-64:], bitorder="little").tobytes(), "little", signed=True) for b in bits]
    prints = [np.packbits(b, bitorder="little").view(np.int64).tolist() for b in bits]
    nodes = spark.createDataFrame([(k, w, v) for k, (w, v) in enumerate(zip(prints, values))], "fp bigint, print array<bigint>, segments array<bigint>")
    least = {}
    for k, row in enumerate(values):
        for v in row:
            least.setdefault(v, k)
    want = set()
    for k, row in enumerate(values):
        for v in row:
            for near in {v, *(v | 1 << b for b in range(simhash.STAGE_BITS))} & least.keys():
                if least[near] != k and ((words[k] ^ words[least[near]]) & (1 << 64) - 1).bit_count() <= simhash.WORD_RADIUS and (bits[k] != bits[least[near]]).sum() <= simhash.STAGE_RADIUS:
                    want.add((max(k, least[near]), min(k, least[near])))
    got = {tuple(r) for r in simhash.segment_pairs(nodes).collect()}
    assert got == want
    assert sum((k + 1, k) in got for k in range(0, 120, 2)) >= 50


def test_exact_join_of_sets_apart_leaves_out_no_pair_and_lists_few(spark):
    """A group of near copies, most of whose pairs are just not similar enough: each a component of its own."""
    sets = [simhash.shingle_set(t.encode()) for t in near_copies(5, 150, 2, 120)]
    part, whole = simhash.SIMILARITY
    similar = {(b, a) for a in range(120) for b in range(a + 1, 120) if (part + whole) * len(np.intersect1d(sets[a], sets[b])) >= part * (len(sets[a]) + len(sets[b]))}
    assert 50 < len(similar) < 1500
    rows = [(k, s.view(np.int64).tolist(), simhash.parities(s).tolist()) for k, s in enumerate(sets)]
    table_ = spark.createDataFrame(rows, "fp bigint, shingles array<bigint>, parity array<bigint>")
    none = spark.createDataFrame([], "node bigint, root bigint")
    met = [tuple(r) for r in simhash.still_apart(simhash.sides(simhash.rare_shingles(table_, table_.select("fp")), none, table_)).collect()]
    assert similar <= set(met)
    assert len(set(met)) < 120 * 119 // 2 // 2


def test_a_group_of_near_copies_is_contracted_once_and_not_by_all_its_links(spark, monkeypatch):
    """Its sets lead to many of each other; the rows that are contracted stay in proportion to the sets."""
    texts = near_copies(11, 150, 1, 240) + near_copies(12, 150, 2, 60)
    sets = [brute_set(t) for t in texts]
    root = list(range(len(sets)))
    for k, a in enumerate(sets):
        for b in sorted({root[j] for j in range(k) if 10 * len(a & sets[j]) >= 8 * len(a | sets[j])}, reverse=True):
            lo, hi = sorted((root[k], b))
            root = [lo if r == hi else r for r in root]
    contracted, contract = [], simhash.components
    counted = lambda edges, *rest: contracted.append(edges.distinct().count()) or contract(edges, *rest)
    for module in (simhash, components_module):
        monkeypatch.setattr(module, "components", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == dict(enumerate(root))
    assert sum(contracted) <= 1.5 * len(texts)


def test_widened_components_are_those_of_all_edges(spark):
    """Edges between and within components, of roots, of others and of nodes without any, several between the same two."""
    old = [(5, 1), (6, 5), (9, 8), (20, 8), (30, 31)]
    new = [(6, 20), (5, 9), (1, 8), (6, 1), (40, 41), (31, 50), (0, 50), (7, 7)]
    table_ = lambda edges: spark.createDataFrame(edges, "u bigint, v bigint")
    want = sorted(map(tuple, components(table_(old + new))[0].collect()))
    roots, path = components(table_(old))
    got, _ = components_module.widened(roots, path, table_(new))
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) == 9


@pytest.mark.parametrize("groups", [simhash.fingerprint_groups, simhash.near_duplicates])
def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, groups):
    copied, other, third = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    texts = [(1, copied), (5, copied), (5, other), (5, other), (5, third), (6, other), (None, other)]
    kept = simhash.keep_one_of_each(spark.createDataFrame(texts, "doc_id bigint, text string"), groups).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, copied), (5, other), (5, third), (None, other)])


# Toxicity and language


def brute_segments(scores):
    """Maximal segments by definition: take the best (shortest, leftmost) positive segment, then look to both sides."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-9:
        return []
    a = -best[2]
    b = a - best[1]
    return brute_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(scores[b:])]


def test_maximal_segments():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = [float(x) if x > 0 else -1.0 for x in rng.integers(-3, 4, 12) + rng.random(12)]
        got = toxicity.maximal_segments([(k, s) for k, s in enumerate(scores) if s > 0], -1.0)
        assert [(a, b) for a, b, _ in got] == brute_segments(scores)


def test_toxicity_learns_and_holds_out(spark, odd, empty):
    texts = [(k, " ".join(f"w{(k * 7 + j) % 300}" for j in range(60)) + (" vile scum vile" if k % 4 == 0 else "")) for k in range(800)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k, _ in texts], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity_report(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k, _ in texts if zlib.crc32(str(k).encode()) % 4 == 2}
    assert all(r.predicted == int(r.doc_id % 4 == 0) and 0 <= r.score <= 1 for r in held)
    assert toxicity.reject_toxic(docs, labels).count() == 600
    assert toxicity.toxicity_report(odd, labels).count() == odd.count()
    assert toxicity.toxicity_report(odd, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity_report(empty, labels).collect() == []


def test_language(spark, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.9
    report = {r.doc_id: r for r in langid.language_report(odd).collect()}
    assert report[4].lang_pred == report[5].lang_pred == report[6].lang_pred == "und" and report[1].lang_pred == "en"
    assert langid.language_report(empty).collect() == []


def test_convolution_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in langid.initial(3, rng).items()}
    x, y = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss(q):
        pooled = [(langid.unfolded(q["emb"][x], w) @ q[f"conv{w}"]).max(axis=1) + q[f"shift{w}"] for w in langid.WIDTHS]
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ q["out"] + q["bias"]
        return -np.log(langid.softmax(z)[np.arange(4), y]).mean()

    g = langid.gradients(p, x, y)
    for name, at in (("emb", (int(x[0, 0]), 1)), ("conv3", (4, 2)), ("shift2", (1,)), ("out", (3, 1)), ("bias", (2,))):
        q = {k: v.copy() for k, v in p.items()}
        q[name][at] += 1e-6
        assert abs((loss(q) - loss(p)) / 1e-6 - g[name][at]) < 1e-4
    network = langid.Network({k: v.astype(np.float32) for k, v in p.items()})
    assert np.allclose(-np.log(network.probabilities(x)[np.arange(4), y]).mean(), loss(p), atol=1e-4)
