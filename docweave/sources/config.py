"""Model configuration, dictionaries and asset resolution on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MAX_CONFIG_BYTES = 2 * 1024 * 1024
MAX_CANDIDATES = 10_000


@dataclass(frozen=True)
class Detection:
    """Post-processing of detection maps; the defaults hold where a file names nothing."""

    threshold: float = 0.3
    box_threshold: float = 0.6
    max_candidates: int = 1000
    unclip_ratio: float = 1.5


def parse_yaml(text: str) -> dict:
    """Nested mappings and scalar lists of plain YAML, by indentation; enough for model files, no anchors or flow style."""
    if len(text.encode()) > MAX_CONFIG_BYTES:
        raise ValueError("model_config_invalid: the file is too large")
    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    pending: tuple[dict, str] | None = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        indent, body = len(bare) - len(bare.lstrip()), bare.strip()
        item = body.startswith("- ")
        if pending is not None:
            parent, key = pending
            deeper = indent > stack[-1][0] if not item else indent >= stack[-1][0]
            if deeper:
                parent[key] = [] if item else {}
                stack.append((indent if not item else indent, parent[key]))
            pending = None
        while len(stack) > 1 and (indent < stack[-1][0] or (indent == stack[-1][0] and isinstance(stack[-1][1], list) and not item)):
            stack.pop()
        node = stack[-1][1]
        if item and isinstance(node, list):
            node.append(scalar(body[2:]))
            continue
        if ":" not in body or not isinstance(node, dict):
            raise ValueError(f"model_config_invalid: {body!r}")
        key, _, value = body.partition(":")
        node[key.strip()] = scalar(value) if value.strip() else None
        if not value.strip():
            pending = (node, key.strip())
        if stack[-1][0] < 0:
            stack[-1] = (indent, node)
    return root


def scalar(text: str) -> str | float | int | bool | None:
    text = text.strip().strip("'\"")
    if text in ("", "null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def detection(config: dict, model: str) -> Detection:
    """Checked settings; a name that differs or a value out of range is an error."""
    found = (config.get("Global") or {}).get("model_name")
    if found != model:
        raise ValueError(f"model_config_invalid: model {found!r}")
    post = config.get("PostProcess") or {}
    if post.get("name", "DBPostProcess") != "DBPostProcess":
        raise ValueError("model_config_invalid: post-process")
    d = Detection()
    out = Detection(
        float(post.get("thresh", d.threshold)), float(post.get("box_thresh", d.box_threshold)), min(int(post.get("max_candidates", d.max_candidates)), MAX_CANDIDATES), float(post.get("unclip_ratio", d.unclip_ratio))
    )
    if not (0 <= out.threshold <= 1 and 0 <= out.box_threshold <= 1 and out.max_candidates > 0 and out.unclip_ratio > 0):
        raise ValueError("model_config_invalid: thresholds")
    return out


def dictionary(lines: list[str], total: int | None = None) -> list[str]:
    """Structure tokens by class: empty lines and plain ``<td>`` go, ``<td></td>`` is ensured, marks of start and end come first and last."""
    if any("\r" in line for line in lines):
        raise ValueError("table_model_invalid: line ends")
    tokens = sorted({line for line in lines if line not in ("", "<td>")} | {"<td></td>"}) if total is None else [x for x in lines if x not in ("", "<td>")]
    if "<td></td>" not in tokens:
        tokens.append("<td></td>")
    out = ["sos", *tokens, "eos"]
    if total is not None and len(out) != total:
        raise ValueError(f"table_model_invalid: {len(out)} tokens")
    return out


def resolved(candidates: list[Column]) -> tuple[Column, Column]:
    """The first candidate there is, by precedence, and whether one is ready."""
    asset = F.coalesce(*candidates)
    return asset.alias("asset"), F.when(asset.isNull(), "model_missing").otherwise("ready").alias("status")
