"""Shared calls: planned groups, the fall back to single items, and what a failing item costs."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from docweave.facade import EchoProvider, Scalar, batched
from docweave.operators import recognition as R
from docweave.plans.recognition import MarkedProvider, marked_work


def items(*rows):
    return [R.Item(b, s, o, w, c) for b, s, o, w, c in rows]


def test_planned_groups():
    widths = [320] * 20 + [330, 336, 337, 352, 352, 400]
    groups = list(R.planned(iter(items(*((0, k, 0, w, b"") for k, w in enumerate(widths)), *((1, k, 0, 320, b"") for k in range(70))))))
    # eight of one width, four times merged at most; then what lies within 16 of the least
    assert [[i.width for i in g] for g in groups if g[0].batch_id == 0] == [[320] * 16, [320] * 4 + [330, 336], [337, 352, 352], [400]]
    assert [len(g) for g in groups if g[0].batch_id == 1] == [32, 32, 6]
    assert list(R.planned(iter([]))) == []


@dataclass(frozen=True)
class Loud:
    """Says in ``asked`` what it was called with."""

    asked: list

    def recognize_batch(self, contents):
        self.asked.append(list(contents))
        if b"short" in contents:
            return []
        if b"boom" in contents:
            raise RuntimeError
        return MarkedProvider().recognize_batch(contents)


def test_fallback_isolates_items_and_skips_finished_slots():
    loud = Loud([])
    group = items((0, 1, 0, 9, b"F1"), (0, 2, 0, 9, b"A2"), (0, 2, 1, 9, b"F2"), (0, 3, 0, 9, b"D3"), (0, 4, 0, 9, b"S4"))
    later = items((0, 1, 1, 50, b"F5"), (0, 2, 2, 50, b"A6"), (0, 3, 1, 50, b"F7"))
    rows = list(R.called(loud, iter([group, later, items((1, 2, 0, 9, b"F8"))])))
    assert [(r[1], r[2], r[5], r[7]) for r in rows] == [
        (1, 0, "fallback", None), (2, 0, "fallback", "native_failed"), (2, 1, "skipped", None), (3, 0, "fallback", "decode_failed"), (4, 0, "fallback", None),
        (2, 2, "skipped", None), (3, 1, "skipped", None), (1, 1, "call", None), (2, 0, "call", None),
    ]
    assert loud.asked == [[b"F1", b"A2", b"F2", b"D3", b"S4"], [b"F1"], [b"A2"], [b"D3"], [b"S4"], [b"F5"], [b"F8"]]


def test_a_call_that_miscounts_or_breaks():
    rows = list(R.called(Loud([]), iter([items((0, 1, 0, 9, b"short")), items((0, 2, 0, 9, b"boom"), (0, 3, 0, 9, b"F"))])))
    assert [(r[1], r[5], r[7]) for r in rows] == [(1, "call", "provider_output_invalid"), (2, "fallback", "runtime_failed"), (3, "fallback", None)]


def test_providers_without_shared_calls(spark):
    @dataclass(frozen=True)
    class Alone:
        def recognize(self, content):
            if content == b"bad":
                raise KeyError
            return [(content.decode(), 0.5)]

    assert batched(Alone()) == Scalar(Alone()) and batched(EchoProvider()) == EchoProvider()
    assert batched(Alone()).recognize_batch([b"a", b"bad"]) == [[("a", 0.5)], R.ItemFailure("runtime_failed")]


def test_every_way_of_a_call_occurs(spark, sf):
    rows = R.recognized(marked_work(spark, sf), MarkedProvider()).collect()
    modes = Counter((r.mode, r.error) for r in rows)
    assert {("call", None), ("call", "decode_failed"), ("fallback", None), ("fallback", "native_failed"), ("fallback", "decode_failed"), ("skipped", None)} <= set(modes)
    assert R.recognized(marked_work(spark, sf).limit(0), MarkedProvider()).count() == 0
