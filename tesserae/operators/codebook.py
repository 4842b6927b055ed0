"""Codebooks: categories with exclusion groups and shortcuts, versions, import and export."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import asdict, dataclass, field, replace


def slug(name: str, most: int = 48) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")[:most]


@dataclass(frozen=True)
class Category:
    cat_id: str
    title: str
    description: str = ""
    exclusion_group: str | None = None
    shortcut_key: str | None = None
    color: str | None = None


@dataclass
class Codebook:
    codebook_id: str
    name: str
    categories: list[Category] = field(default_factory=list)
    version: str = "1.0.0"
    history: list[tuple[str, list[Category]]] = field(default_factory=list)

    def problems(self) -> list[str]:
        ids, keys = [c.cat_id for c in self.categories], [c.shortcut_key for c in self.categories if c.shortcut_key]
        return [f"duplicate_id:{x}" for x in dict.fromkeys(ids) if ids.count(x) > 1] + [f"duplicate_shortcut:{x}" for x in dict.fromkeys(keys) if keys.count(x) > 1] + [f"untitled:{c.cat_id}" for c in self.categories if not c.title.strip()]

    def add(self, title: str, **more: str | None) -> Category:
        base, n = slug(title) or "category", 1
        taken = {c.cat_id for c in self.categories}
        cat_id = base
        while cat_id in taken:
            n += 1
            cat_id = f"{base}_{n}"
        made = Category(cat_id, title.strip(), **more)
        self._change([*self.categories, made])
        return made

    def update(self, cat_id: str, **changes: str | None) -> None:
        self._change([replace(c, **changes) if c.cat_id == cat_id else c for c in self.categories])

    def remove(self, cat_id: str) -> None:
        self._change([c for c in self.categories if c.cat_id != cat_id])

    def _change(self, categories: list[Category]) -> None:
        trial = replace_categories(self, categories)
        if found := trial.problems():
            raise ValueError(", ".join(found))
        self.history.append((self.version, copy.copy(self.categories)))
        self.categories = categories
        m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", self.version)
        self.version = f"{m[1]}.{m[2]}.{int(m[3]) + 1}" if m else f"{self.version}.1"

    def at(self, index: int) -> list[Category]:
        """The categories of an earlier version; negative numbers count from the end."""
        return [*(c for _, c in self.history), self.categories][index]

    def to_json(self) -> str:
        return json.dumps({"codebook_id": self.codebook_id, "name": self.name, "version": self.version, "categories": [asdict(c) for c in self.categories]}, ensure_ascii=False)

    def rows(self) -> list[tuple]:
        """Rows for a categories table."""
        return [(self.codebook_id, *asdict(c).values()) for c in self.categories]


SCHEMA = "codebook_id string, cat_id string, title string, description string, exclusion_group string, shortcut_key string, color string"


def replace_categories(book: Codebook, categories: list[Category]) -> Codebook:
    return Codebook(book.codebook_id, book.name, categories, book.version)


def from_json(text: str) -> Codebook:
    """A codebook from JSON; of colliding shortcuts the first one stays."""
    raw, seen, made = json.loads(text), set(), []
    for c in raw.get("categories", []):
        known = {k: c.get(k) for k in Category.__dataclass_fields__ if c.get(k) is not None}
        known.setdefault("cat_id", slug(c.get("title", "")))
        if known.get("shortcut_key") in seen:
            known.pop("shortcut_key")
        seen.add(known.get("shortcut_key"))
        made.append(Category(**known))
    return Codebook(raw.get("codebook_id") or slug(raw["name"]), raw["name"], made, raw.get("version", "1.0.0"))


def starter(codebook_id: str = "starter") -> Codebook:
    """A first codebook: four exclusive grades of severity, and misinformation beside them."""
    grades = [Category(slug(t), t, exclusion_group="severity", shortcut_key=str(k)) for k, t in enumerate(("Hate speech", "Harassment", "Legitimate", "Unsure"), 1)]
    return Codebook(codebook_id, "Starter codebook", [*grades, Category("misinformation", "Misinformation", shortcut_key="5")])
