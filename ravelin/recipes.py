"""Recipes: a run's settings as a mapping, as text, and back.

A recipe's text is a line of words: `name` for true, `name=value` for a JSON value, a list's name once for each of its items
(`name+=item`). Names come in order, so equal recipes have equal texts.
"""

from __future__ import annotations

import json
import shlex


def to_words(recipe: dict) -> list[str]:
    """The recipe's words; entries that are false, empty or None don't count and aren't written."""
    words = []
    for name, value in sorted(recipe.items()):
        if value is True:
            words.append(name)
        elif isinstance(value, list):
            words += [f"{name}+={json.dumps(item, sort_keys=True)}" for item in value]
        elif value not in (None, False, "", {}):
            words.append(f"{name}={json.dumps(value, sort_keys=True)}")
    return words


def from_words(words: list[str]) -> dict:
    recipe: dict = {}
    for word in words:
        name, equal, value = word.partition("=")
        if not name.rstrip("+") or name in recipe:
            raise ValueError(f"no name, or one that stands twice: {word}")
        if not equal:
            recipe[name] = True
        elif name.endswith("+"):
            recipe.setdefault(name[:-1], []).append(json.loads(value))
        else:
            recipe[name] = json.loads(value)
    return recipe


def to_text(recipe: dict) -> str:
    return shlex.join(to_words(recipe))


def from_text(text: str) -> dict:
    return from_words(shlex.split(text))


def from_config(config: dict, defaults: dict) -> dict:
    """What a stored configuration says beyond the defaults; reading it back over the defaults gives the configuration."""
    return {k: v for k, v in config.items() if v != defaults.get(k) and (v or defaults.get(k))}


def to_config(recipe: dict, defaults: dict) -> dict:
    if unknown := recipe.keys() - defaults.keys():
        raise KeyError(f"no such settings: {sorted(unknown)}")
    return defaults | recipe


def changed(recipe: dict, base: dict) -> list[str]:
    return sorted(k for k in recipe.keys() | base.keys() if recipe.get(k) != base.get(k))


def label(recipe: dict, base: dict) -> str:
    """A family's name: the entry that differs (within nested settings, entry.setting), `several` or `same`."""
    names = changed(recipe, base)
    if len(names) != 1:
        return "several" if names else "same"
    a, b = recipe.get(names[0]), base.get(names[0])
    if isinstance(a or {}, dict) and isinstance(b or {}, dict) and (a or b):
        inner = changed(a or {}, b or {})
        return f"{names[0]}.{inner[0]}" if len(inner) == 1 else "several"
    return names[0]
