"""What a plot needs to know: read from JSON and the command line, merged and checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from seqloom.errors import ConfigError, InvalidInput
from seqloom.plans.region import Region, parse_region

#: What is said of requests that can't be plotted.
SAID = {
    "object": "not a JSON object",
    "key": "unknown key",
    "type": "not of the option's type",
    "sequences": "give sequence, or fst_sequence and snd_sequence",
    "sequence": "a sequence is missing",
    "tracks": "give methylation, or fst_methylation and snd_methylation",
    "both": "methylation is needed for both axes or none",
    "match": "one sequence goes with one methylation track, two with two",
    "regions": "give region, or fst_region and snd_region",
    "threshold": "the methylation threshold is a percentage from 0 to 100",
    "side": "the plot's side is 350 to 12500 pixels",
    "word": "words have at least one base",
    "mismatch": "on_mismatch is prune or error",
    "region": "no region",
    "extension": "unknown file extension",
}

@dataclass(frozen=True)
class Config:
    """All options; None means not given.  ``sequence`` stands for both axes, ``fst_`` is x and ``snd_`` is y."""

    sequence: str | None = None
    fst_sequence: str | None = None
    snd_sequence: str | None = None
    methylation: str | None = None
    fst_methylation: str | None = None
    snd_methylation: str | None = None
    region: str | None = None
    fst_region: str | None = None
    snd_region: str | None = None
    fst_rev: bool | None = None
    snd_rev: bool | None = None
    on_mismatch: str | None = None
    methylation_threshold: float | None = None
    word_length: int | None = None
    parallel: bool | None = None
    output_dir: str | None = None
    plot_side: int | None = None
    dot_size: int | None = None
    enlarge_small: bool | None = None

    def merged(self, other: Config) -> Config:
        """``other`` over this one, where it gives a value."""
        return replace(self, **{f.name: v for f in fields(self) if (v := getattr(other, f.name)) is not None})

    def with_defaults(self) -> Config:
        start = Config(fst_rev=False, snd_rev=False, on_mismatch="prune", methylation_threshold=0.0, word_length=21, parallel=False, output_dir=".", plot_side=4000, dot_size=1, enlarge_small=False)
        return start.merged(self)

    def checked(self) -> Config:
        """With defaults; raises on what can't be plotted."""
        c = self.with_defaults()
        if c.sequence is not None and (c.fst_sequence or c.snd_sequence):
            raise ConfigError(SAID["sequences"])
        if c.sequence is None and not (c.fst_sequence and c.snd_sequence):
            raise ConfigError(SAID["sequence"])
        if c.methylation is not None and (c.fst_methylation or c.snd_methylation):
            raise ConfigError(SAID["tracks"])
        if bool(c.fst_methylation) != bool(c.snd_methylation):
            raise ConfigError(SAID["both"])
        if (c.methylation is not None and c.sequence is None) or (c.fst_methylation is not None and c.sequence is not None):
            raise InvalidInput(SAID["match"])
        if c.region is not None and (c.fst_region or c.snd_region):
            raise ConfigError(SAID["regions"])
        if not 0 <= c.methylation_threshold <= 100:
            raise InvalidInput(SAID["threshold"])
        if not 350 <= c.plot_side <= 12_500:
            raise InvalidInput(SAID["side"])
        if c.word_length < 1:
            raise InvalidInput(SAID["word"])
        if c.on_mismatch not in ("prune", "error"):
            raise InvalidInput(SAID["mismatch"])
        for text in (c.region, c.fst_region, c.snd_region):
            if text is not None and parse_region(text) is None:
                raise InvalidInput(f"{SAID['region']}: '{text}'")
        return c

    def regions(self) -> tuple[Region | None, Region | None]:
        """Region of each axis."""
        fst, snd = self.fst_region or self.region, self.snd_region or self.region
        return (parse_region(fst) if fst else None), (parse_region(snd) if snd else None)


#: JSON values that an option of each type takes.
_JSON = {"str": str, "bool": bool, "int": int, "float": (int, float)}


def load_json(path: str) -> Config:
    """A configuration file: an object with keys as the fields of ``Config``; unknown ones and other types are errors."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: {SAID['object']}")
    kinds = {f.name: f.type.split(" ")[0] for f in fields(Config)}
    if unknown := set(data) - set(kinds):
        raise ConfigError(f"{path}: {SAID['key']}: '{min(unknown)}'")
    for name, value in data.items():
        if value is not None and (not isinstance(value, _JSON[kinds[name]]) or (isinstance(value, bool) and kinds[name] != "bool")):
            raise ConfigError(f"{path}: {SAID['type']}: '{name}'")
    return Config(**data)
