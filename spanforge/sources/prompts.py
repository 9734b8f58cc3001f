"""Prompt templates with includes."""

from __future__ import annotations

import re
from pathlib import Path

_INCLUDE = re.compile(r"\{\{\s*include\s*:?\s*([^}\s]+)\s*\}\}")


def load_prompt(name: str, folders: list[str]) -> str:
    """A template with {{include name}} resolved. A fragment is looked for beside the
    file that names it, then in ``folders``; one that already stands anywhere in this
    rendering is left out the next time."""
    used: set[Path] = set()

    def render(file: Path) -> str:
        used.add(file)
        return _INCLUDE.sub(lambda m: include(m[1], file.parent), file.read_text(encoding="utf-8"))

    def include(target: str, beside: Path) -> str:
        file = find(target, [beside, *map(Path, folders)])
        return "" if file in used else render(file)

    def find(target: str, places: list[Path]) -> Path:
        for place in places:
            if (place / target).is_file():
                return (place / target).resolve()
        raise FileNotFoundError(target)

    return render(find(name, [Path(f) for f in folders]))


def version(text: str) -> str:
    """What stands behind PROMPT VERSION: in the first line, '' if nothing does."""
    first = text.split("\n", 1)[0]
    return first.partition("PROMPT VERSION:")[2].strip()


def prompt_variants(spark, folder: str, variants: list[str], dimensions: list[str], pattern: str = "{variant}_{dimension}.txt"):
    """(variant, dimension, template) for each pair, from a folder of files."""
    rows = [(v, d, load_prompt(pattern.format(variant=v, dimension=d), [folder])) for v in variants for d in dimensions]
    return spark.createDataFrame(rows, "variant string, dimension string, template string")
