"""Text drawn into images, in block letters of three by five squares."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from eventloom.functions.color import Color, color_to_ints

#: Each letter's five rows from the top as an octal digit, whose bits are the squares from the left.
GLYPHS = {
    "0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71122", "8": "75757", "9": "75717",
    "A": "25755", "B": "65656", "C": "34443", "D": "65556", "E": "74647", "F": "74644", "G": "34553", "H": "55755", "I": "72227", "J": "11152",
    "K": "55655", "L": "44447", "M": "57755", "N": "65555", "O": "25552", "P": "65644", "Q": "25573", "R": "65655", "S": "34216", "T": "72222",
    "U": "55557", "V": "55552", "W": "55775", "X": "55255", "Y": "55222", "Z": "71247",
    " ": "00000", ":": "02020", ".": "00002", ",": "00024", "-": "00700", "+": "02720", "/": "11244", "(": "12221", ")": "42224", "×": "05250",
    "=": "07070", "%": "51245", "!": "22202", "?": "71202", "'": "22000", "_": "00007", "µ": "05574", "#": "57575", "*": "52725",
}
#: What letters that aren't known look like.
UNKNOWN = "77777"


def letters(text: str) -> np.ndarray:
    """The squares of a line of text, five high, one free between letters; small letters look like large ones."""
    columns = []
    for c in text:
        glyph = GLYPHS.get(c, GLYPHS.get(c.upper(), UNKNOWN))
        columns.append(np.array([[int(row) >> b & 1 for b in (2, 1, 0)] + [0] for row in glyph], bool))
    return np.concatenate(columns, 1)[:, :-1] if columns else np.zeros((5, 0), bool)


def drawn(image: np.ndarray, text: str, x: int, y: int, size: int, color: Color) -> np.ndarray:
    """A copy of ``image`` with ``text`` from (x, y) on, about ``size`` high; what lies outside is cut off."""
    out, square = image.copy(), max(1, size // 5)
    squares = letters(text).repeat(square, 0).repeat(square, 1)
    part = out[max(0, y) : max(0, y + squares.shape[0]), max(0, x) : max(0, x + squares.shape[1])]
    squares = squares[max(0, -y) :, max(0, -x) :][: part.shape[0], : part.shape[1]]
    part[squares] = color_to_ints(color)
    return out


def writer(text: str | Callable[[int], str], x: int, y: int, size: int, color: Color) -> Callable[[np.ndarray, int], np.ndarray]:
    """A function of an image and its time that draws ``text``, or what it gives for the time."""
    return lambda image, t: drawn(image, text if isinstance(text, str) else text(t), x, y, size, color)
