"""Made corpora whose true relations are known: documents of atoms, in families of one base document and edited versions.

A family is a function of its seed and number alone, so families are made in parallel and always alike.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The edits a version may be made by, and the layouts among them; all others are laid out plainly.
EDITS = ("copy", "crlf", "rewrap", "tight", "wraptight", "sparse", "superset", "shrunk", "reorder", "additive", "conflict")
LAYOUTS = ("plain", "crlf", "rewrap", "tight", "wraptight", "sparse")
BOILER = {"head": "Internal draft, for the working group only.", "foot": "End of text; send corrections to the editors."}
WIDTH = 72
_FILL = "a the and of in to for with when while some each any more most only".split()


def wrap(text: str, width: int = WIDTH) -> str:
    """The words of a text, on lines of at most ``width`` characters where words allow; only single spaces separate words."""
    lines: list[str] = []
    for word in text.split(" "):
        if lines and lines[-1] and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        elif lines and not lines[-1]:
            lines[-1] = word
        else:
            lines.append(word)
    return "\n".join(lines)


def laid_out(paragraphs: list[str], layout: str, draw: random.Random) -> str:
    if layout in ("rewrap", "wraptight"):
        paragraphs = [wrap(p) for p in paragraphs]
    if layout == "sparse":
        paragraphs = [p.replace(". ", ".\n\n") for p in paragraphs]
    if layout == "crlf":
        paragraphs = [p + draw.choice(["", "", "  "]) for p in paragraphs]
    text = ("\n" if layout in ("tight", "wraptight") else "\n\n").join(paragraphs) + "\n"
    return text.replace("\n", "\r\n") if layout == "crlf" else text


class _Family:
    def __init__(self, seed: int, number: int):
        self.draw = random.Random(f"{seed}/{number}")
        self.name = f"s{seed}f{number}"
        syllables = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
        self.word = lambda: "".join(self.draw.choices(syllables, k=self.draw.randint(2, 4)))
        self.topic = [self.word() for _ in range(80)]
        self.atoms: dict[str, tuple[str, str, bool]] = {f"s{seed}{k}": (text, f"s{seed}{k}", True) for k, text in BOILER.items()}
        self.ends = list(self.atoms)

    def atom(self, text: str, root: str | None = None) -> str:
        name = f"{self.name}a{len(self.atoms)}"
        self.atoms[name] = (text, root or name, False)
        return name

    def paragraph(self) -> str:
        def run(least: int, most: int) -> str:
            return " ".join(self.draw.choice(self.topic if self.draw.random() < 0.7 else _FILL) for _ in range(self.draw.randint(least, most)))

        if self.draw.random() < 0.25:  # a list, whose items end in nothing
            return "\n".join("- " + run(6, 10) for _ in range(self.draw.randint(3, 5)))
        return " ".join(run(8, 14) + "." for _ in range(self.draw.randint(3, 5)))

    def edited(self, name: str) -> str:
        """An atom with one word put in or replaced."""
        text, root, _ = self.atoms[name]
        words = text.split(" ")
        at = self.draw.randrange(1, len(words) - 1)
        return self.atom(" ".join([*words[:at], *(["never", words[at]] if self.draw.random() < 0.5 else [self.word()]), *words[at + 1 :]]), root)

    def version(self, base: list[str], edit: str) -> list[str]:
        d, out = self.draw, list(base)
        if edit in ("superset", "additive"):
            for _ in range(d.randint(2, 4)):
                out.insert(d.randint(0, len(out)), self.atom(self.paragraph()))
        elif edit == "shrunk":
            for _ in range(min(d.randint(2, 4), len(out) - 7)):
                del out[d.randrange(len(out))]
        elif edit == "reorder":
            while out == base:
                d.shuffle(out)
        elif edit == "conflict":
            at = d.choice([k for k, a in enumerate(out) if not self.atoms[a][2]])
            out[at] = self.edited(out[at])
        return out

    def docs(self) -> list[tuple[str, list[str], str]]:
        d = self.draw
        base = [self.atom(self.paragraph()) for _ in range(d.randint(10, 14))]
        if d.random() < 0.5:
            base = [self.ends[0], *base, self.ends[1]]
        out = [("base", base, "plain")]
        out += [(f"{e}{k}", self.version(base, e), e if e in LAYOUTS else "plain") for k, e in enumerate(d.sample(EDITS, d.randint(5, 8)))]
        return [(f"{self.name}-{n}.md", atoms, layout) for n, atoms, layout in out]


def make_corpus(spark: SparkSession, seeds: list[int], families: int = 8) -> tuple[DataFrame, DataFrame]:
    """``docs`` (seed, id, atoms, text, render) and ``atoms`` (id, text, root, boiler) of some families for each seed, and two
    documents of boilerplate alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for seed, number in zip(rows["seed"].tolist(), rows["number"].tolist(), strict=True):
                family = _Family(seed, number)
                docs = family.docs() if number >= 0 else [(f"s{seed}t-{k}.md", family.ends[: k + 1], "plain") for k in range(2)]
                for name, atoms, layout in docs:
                    known = [(a, *family.atoms[a]) for a in dict.fromkeys(atoms)]
                    text = laid_out([family.atoms[a][0] for a in atoms], layout, family.draw)
                    out.append((seed, name, atoms, text, layout, [{"id": i, "text": t, "root": r, "boiler": b} for i, t, r, b in known]))
            yield pd.DataFrame(out, columns=["seed", "id", "atoms", "text", "render", "known"])

    wanted = spark.createDataFrame([(s, k) for s in seeds for k in range(-1, families)], "seed int, number int").repartition(max(1, len(seeds)))
    made = wanted.mapInPandas(run, "seed int, id string, atoms array<string>, text string, render string, known array<struct<id:string,text:string,root:string,boiler:boolean>>")
    return made.drop("known"), made.select(F.explode("known").alias("k")).select("k.*").distinct()
