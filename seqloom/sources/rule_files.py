"""Rule and defaults files in YAML, read on the driver (they are small configuration)."""

from __future__ import annotations

from pathlib import Path

from ..operators.rules import Rule


class BadRule(ValueError):
    """A rule with keys that are not known."""


_KEYS = {
    "name", "category", "priority", "description", "arabic_name", "pattern", "action", "acoustic_expectations", "acoustic_effect",
    "examples", "error_types", "verification_criteria", "notes",
}


def _names(value) -> tuple[tuple[str, ...], bool]:
    """Symbols of a set and whether it is negated: x, [a b], ![a b], or a list."""
    if not value:
        return (), False
    if isinstance(value, (list, tuple)):
        return tuple(map(str, value)), False
    text = str(value).strip()
    negated = text.startswith("!")
    text = text.lstrip("!").strip()
    if text.startswith("[") and text.endswith("]"):
        return tuple(x for x in text[1:-1].replace(",", " ").split()), negated
    return (text,), negated


def rule_from(entry: dict) -> Rule:
    unknown = set(entry) - _KEYS
    if unknown:
        raise BadRule(f"{entry.get('name')}: {sorted(unknown)}")
    pattern = entry.get("pattern") or {}
    prev, not_prev = _names(pattern.get("preceding_context"))
    nxt, not_next = _names(pattern.get("following_context"))
    return Rule(
        name=entry["name"], target=_names(pattern.get("target"))[0], category=entry.get("category", "general"), priority=int(entry.get("priority", 0)),
        prev=() if not_prev else prev, not_prev=prev if not_prev else (), next=() if not_next else nxt, not_next=nxt if not_next else (),
        conditions=dict(pattern.get("conditions") or {}),
    )


def parse_rules(text: str, name: str = "") -> tuple[list[Rule], list[str]]:
    """Rules of one YAML text in its order, and what was wrong with those that were left out."""
    import yaml

    rules, problems = [], []
    data = yaml.safe_load(text) or {}
    for entry in data.get("rules", []) if isinstance(data, dict) else data:
        try:
            rules.append(rule_from(entry))
        except (BadRule, KeyError, TypeError, ValueError) as problem:
            problems.append(f"{name}: {problem}")
    return rules, problems


def read_rules(*paths: str | Path) -> tuple[list[Rule], list[str]]:
    """Rules in file order, and what was wrong with those that were left out."""
    parts = [parse_rules(Path(path).read_text(encoding="utf-8"), str(path)) for path in paths]
    return [r for rules, _ in parts for r in rules], [x for _, problems in parts for x in problems]
