"""Inventories of sounds, spelling maps and acoustic defaults in YAML, read on the driver (small configuration)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOUNDS = (
    "symbol string, arabic string, kind string, manner string, place string, voicing boolean, emphatic boolean, height string, backness string, "
    "length string, nasalized boolean, duration_factor double, f1 double, f2 double, f3 double"
)


def parse(text: str):
    import yaml

    return yaml.safe_load(text) or {}


def _load(path: str | Path):
    return parse(Path(path).read_text(encoding="utf-8"))


def read_sounds(spark: SparkSession, *paths: str | Path) -> DataFrame:
    """One row a sound of the lists ``consonants``, ``vowels`` and any other of sounds, in columns ``SOUNDS``.

    Files are read in order and a symbol that comes again replaces the one before it.
    """
    return sounds_of(spark, *[_load(path) for path in paths])


def sounds_of(spark: SparkSession, *inventories: dict) -> DataFrame:
    """The same from parsed files."""
    found = {}
    for inventory in inventories:
        for kind, entries in inventory.items():
            for e in entries if isinstance(entries, list) else ():
                if isinstance(e, dict) and "symbol" in e:
                    f, hz = e.get("features") or {}, e.get("formants") or {}
                    number = lambda x: None if x is None else float(x)
                    found[e["symbol"]] = (
                        e["symbol"], e.get("arabic"), kind, f.get("manner"), f.get("place"), f.get("voicing"), bool(f.get("emphatic", False)), f.get("height"),
                        f.get("backness"), f.get("length"), bool(f.get("nasalized", False)), float(e.get("duration_factor", 1.0)),
                        *[number(hz.get(k)) for k in ("f1", "f2", "f3")],
                    )
    return spark.createDataFrame(list(found.values()), SOUNDS)


def read_spelling(path: str | Path, part: str = "consonant_mappings") -> dict[str, str]:
    """The map from a letter to its sound; only plain entries count."""
    return spelling_of(_load(path), part)


def spelling_of(parsed: dict, part: str = "consonant_mappings") -> dict[str, str]:
    return {str(k): str(v) for k, v in (parsed.get(part) or {}).items() if isinstance(v, str)}


def read_defaults(path: str | Path) -> dict:
    """Acoustic defaults as nested maps; a file that is absent or not to be read gives none, so built-in values hold."""
    try:
        return _load(path)
    except Exception:  # an unreadable file is as good as none
        return {}


def setting(defaults: dict, path: str, built_in):
    """The value at a dotted path, or the built-in one."""
    here = defaults
    for key in path.split("."):
        here = here.get(key) if isinstance(here, dict) else None
    return built_in if here is None else here


def with_dimensions(sounds: DataFrame, inventory: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Features of each sound beside it; one that the inventory lacks counts as a plain consonant."""
    i = inventory.withColumnRenamed("symbol", "_symbol")
    j = sounds.join(F.broadcast(i), F.col(symbol) == F.col("_symbol"), "left").drop("_symbol")  # a few dozen sounds
    return j.withColumns({
        "kind": F.coalesce("kind", F.lit("consonants")), "emphatic": F.coalesce("emphatic", F.lit(False)), "nasalized": F.coalesce("nasalized", F.lit(False)),
        "duration_factor": F.coalesce("duration_factor", F.lit(1.0)),
    })
