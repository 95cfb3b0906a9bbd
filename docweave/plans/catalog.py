"""Catalogue of the engine's own queries (the training-data ones live apart)."""

from __future__ import annotations

from docweave.plans import admission, aggregates, checks, containers, contracts, evidence, images, joins, recognition, scalars, sequences, streams, structure, validation
from docweave.registry import Registry

REGISTRY = Registry().merge(*(m.REGISTRY for m in (admission, validation, contracts, joins, evidence, aggregates, sequences, scalars, recognition, structure, containers, images, checks, streams)))
