"""Readers and models for tests and queries, which answer by rule: no PDF or image is decoded."""

from __future__ import annotations

import json


class PlainImages:
    """Pages parted by form feeds; an image is the page's text, which describes its tables as JSON (or is none)."""

    def images(self, content: bytes, dpi: int) -> list[tuple[int, int, bytes]]:
        return [(600, 800, page.encode()) for page in content.decode("utf-8").split("\f")]


def described(image: bytes) -> dict:
    """What the last line of an image that begins with a brace says of it."""
    lines = [x for x in image.decode("utf-8").split("\n") if x.startswith("{")]
    return json.loads(lines[-1]) if lines else {}


class DescribedModels:
    """Detector and structure model that read the description: ``tables`` are ``{score, box, elements}``."""

    def tables(self, image: bytes):
        if b"NO MODEL" in image:
            raise ValueError("the model failed")
        return [(t["score"], tuple(t["box"])) for t in described(image).get("tables", [])]

    def elements(self, image: bytes, box):
        own = next(t for t in described(image)["tables"] if tuple(map(float, t["box"])) == tuple(box))
        return [(label, tuple(b), score) for label, b, score in own.get("elements", [])]


class DescribedTexts:
    """A reader that gives the texts of the description whose box lies inside the one that is read; ``which`` names its list."""

    def __init__(self, which: str):
        self.which = which

    def lines(self, image: bytes, box) -> list[str]:
        x0, y0, x1, y1 = box
        inside = [t for (a, b, c, d), t in described(image).get(self.which, []) if x0 <= a and y0 <= b and c <= x1 and d <= y1]
        if "FAIL" in inside:
            raise ValueError("can't read")
        return inside


class Ruled:
    """A reader that answers by the numbers of the box: ``rule`` maps whole (x0, y0, x1, y1) to a text, to nothing (None), or raises."""

    def __init__(self, rule):
        self.rule = rule

    def lines(self, image: bytes, box) -> list[str]:
        text = self.rule(*map(int, box))
        return [] if text is None else [text]
