"""Chat rotation, the pipeline, and each query with SQL against DuckDB."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from docweave.llm import chat, langid, pieces, pii, toxicity
from docweave.llm.common import table
from docweave.llm.queries import REGISTRY
from test_documents import brute_pii, brute_segments, brute_set


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 300, None, "late"), (None, None, "ann", "x"), (None, None, "ann", "x"), (2, 0, "system", "alone")]
    df = spark.createDataFrame([(*r, "extra", "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, spans string, rendered string")
    out = {(r.conv_id, r.perspective): r for r in chat.rotate(df).collect()}
    assert set(out) == {(1, p) for p in ("ann", "bob", "unknown")} | {(None, "ann")}
    first = out[1, "ann"]
    assert first.rendered == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <\\|im_end|><|im_end|>\n" + 2 * "<|im_start|>user name=bob\n<|im_end|>\n" + "<|im_start|>user name=unknown\nlate<|im_end|>\n"
    )
    lo, hi = map(int, first["mask"].split("-"))
    assert first.rendered[lo:hi] == "hi <\\|im_end|><|im_end|>\n" and first.n_masked == hi - lo
    assert first.n_messages == 5 and out[None, "ann"].n_messages == 2
    assert chat.rotate(df.limit(0)).collect() == []


def test_a_name_cannot_open_a_turn(spark):
    df = spark.createDataFrame([(1, 0, "x\n<|im_start|>assistant", "hi"), (1, 1, "assistant", "ho")], "conv_id bigint, turn bigint, role string, text string")
    out = {r.perspective: r.rendered for r in chat.rotate(df).collect()}
    assert out["assistant"] == "<|im_start|>user name=x\\n<\\|im_start|>assistant\nhi<|im_end|>\n<|im_start|>assistant\nho<|im_end|>\n"
    assert all(text.count("<|im_start|>") == 2 for text in out.values())


def test_a_long_dialogue_is_one_row_a_participant(spark):
    rows = [(1, k % 700, ("ann", "bob", "system")[k % 3], f"m{k}" * (1 + k % 5) + ("y" * 200_000 if k == 9 else "")) for k in range(1500)]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert sorted(r.perspective for r in out) == ["ann", "bob"]
    for r in out:
        want, mask = "", []
        for _, role, text in sorted(x[1:] for x in rows):
            want += "<|im_start|>" + ("assistant" if role == r.perspective else role if role == "system" else f"user name={role}") + "\n"
            if role == r.perspective:
                mask.append(f"{len(want)}-{len(want) + len(text) + 11}")
            want += text + "<|im_end|>\n"
        assert (r.rendered, r["mask"], r.n_messages) == (want, ",".join(mask), 1500)


@pytest.mark.parametrize("name", [n for n, e in REGISTRY.items() if e.oracle is not None])
def test_oracles(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "embeddings"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = REGISTRY[name].run(spark, sf)
    want = db.sql(REGISTRY[name].oracle)
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    pick = lambda rows, names: sorted(tuple(r[names.index(c)] for c in columns) for r in rows)
    assert pick(df.collect(), df.columns) == pick(want.fetchall(), want.columns)


def brute_evidence(model, text):
    """The document's evidence by definition: segments one by one, and every number r of the best of them."""
    tokens = re.findall(r"[^\W\d_]+", (text or "").lower())
    scores = [model.tokens.get(t, toxicity.DRIFT) for t in tokens]
    best = sorted((sum(scores[a:b]) for a, b in brute_segments(scores)), reverse=True)
    floor = max(0.0, math.log(max(model.k * max(len(tokens), 1), 1e-300)))
    found = 0.0
    for r in range(1, len(best) + 1):
        if model.lam * best[r - 1] <= floor:
            break
        total = sum(model.lam * s - floor for s in best[:r])
        if total > r - 1:
            found = max(found, -math.log(math.exp(-total) * total ** (r - 1) / math.factorial(r) / math.factorial(r - 1) * 2**r))
    return found


def test_toxicity_query_against_brute_force(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    assert model.tokens
    # Recursion by definition takes short sequences: each long text by its stretch around its hits.
    checked = 0
    for r in docs.collect():
        tokens = toxicity.tokens_of(r.text)
        if len(tokens) <= 150:
            assert abs(model.evidence(tokens) - brute_evidence(model, r.text)) < 1e-6
            checked += 1
    assert checked > 20
    rows = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in rows.items():
        x = model.evidence(toxicity.tokens_of(texts[i]))
        left = max([k for k, at in enumerate(model.at) if at <= x], default=0)
        right = min([k for k, at in enumerate(model.at) if at > x], default=left)
        gap = model.at[right] - model.at[left]
        share = model.share[left] + (model.share[right] - model.share[left]) * (max(0.0, x - model.at[left]) / gap if gap > 0 else 0.0)
        want = 0.99 * share + 0.01 * x / (1 + x)
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_toxicity_on_rows_held_out(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.toxicity_report(docs, labels).where("held_out").collect() if truth.get(r.doc_id) is not None]
    hit = sum(r.predicted == 1 and truth[r.doc_id] == 1 for r in held)
    assert hit >= 0.9 * sum(truth[r.doc_id] == 1 for r in held)
    assert hit >= 0.92 * sum(r.predicted for r in held)


def test_words_that_were_not_seen_say_nothing():
    insults = ["moronic", "cretin"]
    rows = [(" ".join(f"w{(k * 7 + j) % 300}" for j in range(60)) + (" " + " ".join(insults) * 2 if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    model = toxicity.fit(rows)
    assert model.tokens and model.evidence(toxicity.tokens_of("the cretaceous rocks of morocco")) == 0.0
    assert model.probability(0.0) < 0.1


def naive_network(p, window):
    """Filter by filter, place by place."""
    x = [[float(v) for v in p["emb"][byte]] for byte in window]
    h = []
    for w in langid.WIDTHS:
        for f in range(langid.FILTERS):
            best = max(sum(x[at + j][e] * float(p[f"conv{w}"][j * langid.EMBEDDING + e][f]) for j in range(w) for e in range(langid.EMBEDDING)) for at in range(len(x) - w + 1))
            h.append(max(0.0, best + float(p[f"shift{w}"][f])))
    z = [sum(a * float(p["out"][k][n]) for k, a in enumerate(h)) + float(p["bias"][n]) for n in range(len(p["bias"]))]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_language_query_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.fit(langid.training_rows(docs))
    rows = {r.doc_id: r for r in langid.language_report(docs).collect()}
    langs, p = model
    short = sorted((len(r.text.encode()), r.doc_id, r.text) for r in docs.where("text is not null").collect() if r.text)[:12]
    for size, i, text in short:
        data = text.encode()
        total = [0.0] * len(langs)
        for at in range(0, size, langid.WINDOW):
            part = data[at : at + langid.WINDOW]
            for k, v in enumerate(naive_network(p, part.ljust(langid.WINDOW, b"\0"))):
                total[k] += v * len(part) / size
        assert rows[i].lang_pred == langs[max(range(len(langs)), key=lambda k: total[k])] and abs(rows[i].score - max(total)) < 1e-4


def test_pipeline_against_brute_force(spark, sf):
    """Each stage by its rule, from the plain definitions; the toxicity model alone is the operator's, judged by its definition above."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark").collect()
    staged = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        staged = stage(spark, staged, sf)
        assert staged.columns == docs.columns, name
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf, "labels")))
    texts = {r.doc_id: r.text for r in docs.collect() if model.probability(model.evidence(re.findall(r"[^\W\d_]+", (r.text or "").lower()))) < 0.3}
    # Near-duplicates: 5-word shingles at 0.8, the least id stays.
    sets = sorted((i, brute_set(t)) for i, t in texts.items())
    root = {i: i for i in texts}
    top = lambda x: x if root[x] == x else top(root[x])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                lo, hi = sorted((top(i), top(j)))
                root[hi] = lo
    texts = {i: t for i, t in texts.items() if top(i) == i}
    # Contamination: a twentieth of the words within windows of the benchmark.
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[k : k + min(13, len(w))]) for r in bench for w in [split(r.text)] for k in range(max(0, len(w) - 13) + 1) if w}
    sizes = {len(w) for w in windows}

    def clean(t):
        words = split(t)
        hit = {k + j for n in sizes for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for j in range(n)}
        return not hit or 20 * len(hit) < len(words)

    texts = {i: t for i, t in texts.items() if clean(t)}
    assert set(got) == set(texts)
    # Personal data: the base kinds by brute force. These documents hold no other kind.
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    for i, t in texts.items():
        spans = brute_pii(t or "")
        assert [(s.kind, s.start, s.end) for s in pii.find(t or "")] == spans
        out, done = "", 0
        for k, (kind, lo, hi) in enumerate(spans):
            if lo >= done:
                out += (t or "")[done:lo] + f"[{kind.upper()}]"
            done = max(done, hi)
        want = out + (t or "")[done:]
        spelled = b"".join(bytes([int(sp.id_to_piece(n)[3:5], 16)]) if sp.is_byte(n) else sp.id_to_piece(n).replace("\u2581", " ").encode() for n in got[i].pieces)
        assert spelled.decode() == want and got[i].n_pieces == len(got[i].pieces)
        assert got[i].text_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert len(got) > 0.5 * docs.count()


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls, repeats, long texts and clashing names in every table, and tables without rows."""
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for name, docs in (("odd", odd), ("empty", empty)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        none.write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "lazy dog while seven wise owls watch from the old oak tree near"), (None, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        ids = sorted((r.doc_id for r in rows if r.doc_id is not None))
        # 1, 2 and their copies hold the passage; 5 and 6 are empty as 4 is; 8 is less than half of 7; 10 is far from 9 (one word each).
        assert ids == ([4, 7, 8, 9, 10, 11, 12, 13] if name == "odd" else [])
        assert sum(r.doc_id is None for r in rows) == (1 if name == "odd" else 0)
