"""Configuration: frozen dataclasses from YAML or JSON files and dotted command-line options.

A list under a field that is not itself a list stands for several runs; all lists together give their cartesian product,
10 000 runs at most. Options given on the command line override the file; unknown names are errors.
"""

from __future__ import annotations

import argparse
import dataclasses
import enum
import itertools
import json
import typing
from dataclasses import dataclass, field
from pathlib import Path

MOST_RUNS = 10_000
DETECTOR_TYPES = ("REGEX", "MASKER_API", "HOSTED_MASKER_API", "GLINER", "SPACY")


def parsed_choice(value: str, choices: tuple[str, ...]) -> str:
    if (up := str(value).upper()) in choices:
        return up
    raise ValueError(f"{value!r} is none of {', '.join(choices)}")


@dataclass(frozen=True)
class DataConfig:
    input_path: str = ""
    output_path: str = ""
    text_field: str = "text"
    doc_id_field: str | None = None
    ground_truth_field: str | None = None


@dataclass(frozen=True)
class DetectorConfig:
    type: str = "REGEX"
    priority: dict = field(default_factory=dict)
    hierarchy_position: int = 0
    min_confidence: float = 0.0
    labels: list[str] = field(default_factory=list)
    threshold: float = 0.6
    max_length: int = 384
    chunk_overlap: int = 50
    nms_iou: float = 0.8
    top_k: int = 100
    min_span_chars: int = 3
    max_span_chars: int = 80
    retries: int = 2
    chunk_char_limit: int = 4000
    model: str = ""

    def __post_init__(self):
        object.__setattr__(self, "type", parsed_choice(self.type, DETECTOR_TYPES))


@dataclass(frozen=True)
class OverlapConfig:
    iou_threshold: float = 0.75
    overlap_policy: str = "same_type_only"

    def __post_init__(self):
        if not 0 <= self.iou_threshold <= 1:
            raise ValueError(f"iou_threshold {self.iou_threshold} is not between 0 and 1")
        if self.overlap_policy not in ("same_type_only", "cross_type"):
            raise ValueError(f"unknown overlap_policy {self.overlap_policy}")


@dataclass(frozen=True)
class ResolverConfig:
    type: str = "EMBEDDINGS"
    threshold: float = 0.75

    def __post_init__(self):
        object.__setattr__(self, "type", parsed_choice(self.type, ("EMBEDDINGS",)))


@dataclass(frozen=True)
class MaskerConfig:
    method: str = "ENTITY_TAG"
    compat: bool = False

    def __post_init__(self):
        object.__setattr__(self, "method", parsed_choice(self.method, ("ENTITY_TAG", "ASTERISK")))


@dataclass(frozen=True)
class EvaluatorConfig:
    enabled: bool = False
    report_exact: bool = True
    report_by_id: bool = True
    report_iou_thresholds: list[float] = field(default_factory=lambda: [0.10, 0.25, 0.50, 0.75, 0.90])
    optimal_id_mapping: bool = False


@dataclass(frozen=True)
class MetricsConfig:
    enabled: bool = False
    output_dir: str = "runs"


@dataclass(frozen=True)
class PipelineConfig:
    mode: str = "offline"
    data: DataConfig = DataConfig()
    detectors: list[DetectorConfig] = field(default_factory=lambda: [DetectorConfig()])
    overlap: OverlapConfig = OverlapConfig()
    resolvers: list[ResolverConfig] = field(default_factory=list)
    masker: MaskerConfig = MaskerConfig()
    evaluator: EvaluatorConfig = EvaluatorConfig()
    metrics: MetricsConfig = MetricsConfig()

    def __post_init__(self):
        if self.mode not in ("offline", "online"):
            raise ValueError(f"unknown mode {self.mode}")


def _is_list(kind) -> bool:
    return typing.get_origin(kind) is list


def _options(kind, value) -> list:
    """All values that a part of a configuration stands for."""
    if dataclasses.is_dataclass(kind):
        if isinstance(value, list):
            return [x for v in value for x in _options(kind, v)]
        hints = typing.get_type_hints(kind)
        if unknown := set(value) - set(hints):
            raise ValueError(f"{kind.__name__} has no field {', '.join(sorted(unknown))}")
        each = [[(k, x) for x in _options(hints[k], v)] for k, v in value.items()]
        return [dict(c) for c in bounded(each)]
    if _is_list(kind):
        (item,) = typing.get_args(kind)
        if dataclasses.is_dataclass(item):
            return [list(c) for c in bounded([_options(item, v) for v in value])]
        return [value]
    return list(value) if isinstance(value, list) and value else [value]


def bounded(parts: list[list]) -> list[tuple]:
    """Their cartesian product, which may not be larger than MOST_RUNS."""
    n = 1
    for p in parts:
        n *= len(p)
    if n > MOST_RUNS:
        raise ValueError(f"{n} combinations; at most {MOST_RUNS} are allowed")
    return list(itertools.product(*parts))


def _made(kind, value):
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind)
        return kind(**{k: _made(hints[k], v) for k, v in value.items()})
    if _is_list(kind) and dataclasses.is_dataclass(typing.get_args(kind)[0]):
        return [_made(typing.get_args(kind)[0], v) for v in value]
    return value


def expanded(raw: dict) -> list[PipelineConfig]:
    """One configuration per combination."""
    found = _options(PipelineConfig, raw)
    if len(found) > MOST_RUNS:
        raise ValueError(f"{len(found)} combinations; at most {MOST_RUNS} are allowed")
    if raw.get("mode") == "online" and len(found) > 1:
        raise ValueError("online mode takes a single configuration")
    return [_made(PipelineConfig, c) for c in found]


def loaded(path: str) -> dict:
    """A YAML or JSON mapping; an empty file is an empty one, a list is kept under _list."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text) if text.strip() else None
    return {} if raw is None else {"_list": raw} if isinstance(raw, list) else raw


def flags(kind=PipelineConfig, prefix: str = "") -> dict[str, object]:
    """Dotted option names of all plain fields."""
    out: dict[str, object] = {}
    for name, hint in typing.get_type_hints(kind).items():
        if dataclasses.is_dataclass(hint):
            out |= flags(hint, f"{prefix}{name}.")
        elif not (_is_list(hint) and dataclasses.is_dataclass(typing.get_args(hint)[0])):
            out[prefix + name] = hint
    return out


def from_command_line(argv: list[str]) -> list[PipelineConfig]:
    known = flags()
    parser = argparse.ArgumentParser(description="Detect, resolve, mask and evaluate entities.")
    parser.add_argument("--config", help="YAML or JSON file")
    for name in known:
        parser.add_argument(f"--{name}", default=argparse.SUPPRESS)
    given = vars(parser.parse_args(argv))
    path = given.pop("config", None)
    raw = loaded(path) if path else {}
    for name, text in given.items():
        at = raw
        *parents, last = name.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        try:
            at[last] = json.loads(text)
        except ValueError:
            at[last] = text
    return expanded(raw)


def plain(value):
    """Configurations and enumerations as JSON values."""
    if dataclasses.is_dataclass(value):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, enum.Enum):
        return value.name
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple, set)) else value
