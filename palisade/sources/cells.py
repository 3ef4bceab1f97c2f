"""Spreadsheet cell values as text: numbers, and the dates, times and durations that a cell's number format makes of them."""

from __future__ import annotations

import datetime as dt
import re
from xml.etree import ElementTree

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: The numbers of the built-in formats that show dates or times, and those that show elapsed time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 47, *range(50, 59)}
ELAPSED_FORMATS = {46}

_LITERAL = re.compile(r'"[^"]*"|\\.|_.|\*.')
_ELAPSED = re.compile(r"\[(?:h+|m+|s+)\]", re.I)
_BRACKETS = re.compile(r"\[[^\]]*\]")


def kind_of(code: str) -> str:
    """"elapsed", "date" (a date or a time) or "number", by a format's first section."""
    plain = _LITERAL.sub("", code).split(";")[0]
    if _ELAPSED.search(plain):
        return "elapsed"
    letters = _BRACKETS.sub("", plain).lower().replace("general", "")
    return "date" if re.search(r"[dmyhs]", letters) and "#" not in letters else "number"


class Styles:
    """What a workbook's style table says about the numbers of cells."""

    def __init__(self, styles: ElementTree.Element | None = None, since_1904: bool = False):
        self.since_1904, self.kinds = since_1904, []
        if styles is None:
            return
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_SHEET}numFmt")}
        table = styles.find(f"{_SHEET}cellXfs")
        for style in table if table is not None else ():
            number = int(style.get("numFmtId", 0))
            built_in = "date" if number in DATE_FORMATS else "elapsed" if number in ELAPSED_FORMATS else "number"
            self.kinds.append(kind_of(own[number]) if number in own else built_in)

    def text(self, value: str, style: str | None) -> str:
        """A numeric cell's value as text."""
        number = float(value) if re.search(r"[.eE]", value) else int(value)
        at = int(style or 0)
        kind = self.kinds[at] if at < len(self.kinds) else "number"
        if kind == "number":
            return str(number)
        try:
            return str(self._duration(number) if kind == "elapsed" else self._moment(number))
        except (OverflowError, ValueError):
            return "#VALUE!"  # no such date

    @staticmethod
    def _duration(days: float) -> dt.timedelta:
        whole, part = divmod(days, 1)
        return dt.timedelta(days=whole, milliseconds=round(part * 86_400_000))

    def _moment(self, days: float) -> dt.datetime | dt.time:
        passed = self._duration(days)
        if 0 <= days < 1 and not passed.days:
            return (dt.datetime.min + passed).time()
        if self.since_1904:
            return dt.datetime(1904, 1, 1) + passed
        # the calendar from 1900 has a 29 February that never was
        return dt.datetime(1899, 12, 30) + passed + dt.timedelta(days=1 if 0 < days < 60 else 0)
