"""Reading quantities from fields and free text, and decimal-exact conversion to common units."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import ROUND_DOWN, Decimal, localcontext

_L, _PER = r"(?:l|lit(?:er|re)s?|ltr)", r"\s*(?:/|per)\s*"

#: fixed values: how UCUM units are spelt, as patterns without regard to case
SPELLINGS = {
    "mmol/l": rf"(?:mmol|milli ?mole?s?){_PER}{_L}|(?-i:mM)",
    "umol/l": rf"(?:[uµμ]mol|mcmol|micro ?mole?s?){_PER}{_L}|(?-i:[uµμ]M)",
    "mmol/mol": rf"(?:mmol|milli ?mole?s?){_PER}mol",
    "mg/dl": rf"(?:mg|milli ?grams?){_PER}(?:dl|deci ?lit(?:er|re)s?|100\s*ml)|mg\s*%",
    "g/l": rf"(?:gr?|grams?){_PER}{_L}",
    "%": r"%|pct\.?|percent|procent|per cent",
    "kg": r"kgs?\.?|kilos?|kilo ?gram(?:s|men)?",
    "g": r"gr?\.?|grams?|grammen",
    "[lb_av]": r"\[lb_av\]|lbs?\.?|pounds?",
    "cm": r"cms?\.?|centi ?met(?:er|re)s?",
    "m": r"m\.?|mtr\.?|met(?:er|re)s?",
    "mm": r"mm\.?|milli ?met(?:er|re)s?",
    "[in_i]": r"\[in_i\]|in\.?|inch(?:es)?|\"|″|”|''",
    "[ft_i]": r"\[ft_i\]|ft\.?|feet|foot|voet|'|′|’",
    "Cel": r"Cel\.?|[°º]\s*C|℃|C|deg(?:rees?)?\.?\s*C(?:elsius)?|gra?a?den\s*C(?:elsius)?|Celsius",
    "[degF]": r"\[degF\]|[°º]\s*F|℉|F|deg(?:rees?)?\.?\s*F(?:ahrenheit)?|gra?a?den\s*F(?:ahrenheit)?|Fahrenheit",
    "K": r"K|[°º]\s*K|kelvins?",
    "mm[Hg]": r"mm\s*\[?Hg\]?|mm\s*kwik(?:druk)?|milli ?met(?:er|re)s?\s*(?:kwik|Hg|mercury)",
    "cm[Hg]": r"cm\s*\[?Hg\]?|cm\s*kwik|centi ?met(?:er|re)s?\s*(?:kwik|Hg|mercury)",
    "kPa": r"kPa\.?|kilo ?pascals?",
    "ml": r"mls?\.?|cc|milli ?lit(?:er|re)s?",
    "dl": r"dls?\.?|deci ?lit(?:er|re)s?",
    "l": rf"{_L}\.?",
    "min": r"mins?\.?|minutes?|minuut|minuten",
    "h": r"h\.?|hrs?\.?|hours?|uur|uren",
    "s": r"s\.?|secs?\.?|seconds|seconden",
}
#: fixed values: unit fields that name no unit
NO_UNIT = {"", "?", "-", "--", ".", "unk", "unknown", "onbekend", "n/a", "na", "nvt", "n.v.t.", "none", "null", "geen", "asku", "nask", "ni"}

_NUMBER = r"(?<![\w.,/:-])([+-]?\d+(?:[.,]\d+)*)"
_AFTER = r"(?![\w%°/\[\]µμ])"


@dataclass(frozen=True)
class Conversion:
    unit: str
    common: str
    factor: Decimal
    shift: Decimal
    decimals: int


def decimal_of(text: str) -> Decimal | None:
    """A number with a point or a comma; where both occur, the last is the decimal one."""
    last = max(text.rfind("."), text.rfind(","))
    if last >= 0:
        whole, part = re.sub("[.,]", "", text[:last]), text[last + 1 :]
        if len(re.findall("[.,]", text)) > 1 and len(set(re.findall("[.,]", text))) == 1:
            whole, part = whole + part, ""  # several of one kind group thousands
        text = f"{whole or '0'}.{part}" if part else whole
    try:
        return Decimal(text)
    except ArithmeticError:
        return None


class Reader:
    """Finds the quantities that one code's fields and text state, in units listed for that code."""

    def __init__(self, conversions: list[Conversion]):
        self.by_unit = {c.unit: c for c in conversions}
        self.units = list(self.by_unit)
        spelt = [f"(?P<u{k}>{SPELLINGS.get(u, '(?!)')}|{re.escape(u)})" for k, u in enumerate(self.units)]
        # longer spellings first where several units fit, as in mm and mm[Hg]
        any_unit = "|".join(sorted(spelt, key=lambda p: -max(len(x) for x in p.split("|"))))
        flags = re.IGNORECASE
        self._whole = [re.compile(rf"\s*(?:{SPELLINGS.get(u, '(?!)')}|{re.escape(u)})\s*$", flags) for u in self.units]
        self._quantity = re.compile(rf"{_NUMBER}\s*(?:{any_unit}){_AFTER}", flags)
        self._mention = re.compile(rf"(?<![\w/\[.-])(?:{any_unit}){_AFTER}", flags)
        self._seen: dict[str, str | None] = {}  # the same few spellings come again and again
        self._front = re.compile(r"\s*([+-]?\d+(?:[.,]\d+)*)\s*(?!\d)(\D.*)$", re.S)

    def unit_of(self, text: str) -> str | None:
        if text not in self._seen:
            if len(self._seen) >= 10_000:
                self._seen.clear()
            self._seen[text] = next((unit for unit, whole in zip(self.units, self._whole) if whole.match(text)), None)
        return self._seen[text]

    def _named(self, m: re.Match) -> str:
        return self.units[int(next(k for k, v in m.groupdict().items() if v is not None)[1:])]

    def quantities(self, text: str) -> list[tuple[Decimal, str]]:
        """The first quantity in a text; parts that follow each other in different units belong together."""
        out: list[tuple[Decimal, str]] = []
        end = 0
        for m in self._quantity.finditer(text):
            unit, number = self._named(m), decimal_of(m.group(1))
            if number is None:
                continue
            if out and (re.sub(r"[\s,&]|and|en|und|et", "", text[end : m.start()]) or unit in [u for _, u in out]):
                break
            out.append((number, unit))
            end = m.end()
        return out

    def mentioned(self, text: str) -> str | None:
        """The unit that a text without a quantity names."""
        found = [(self._named(m), m.group()) for m in self._mention.finditer(text)]
        if len({u for u, _ in found}) > 1:  # "in" is also a word
            found = [(u, t) for u, t in found if t.lower() != "in"]
        return found[0][0] if found else None

    def read(self, value: Decimal | None, unit: str | None, text: str | None) -> tuple[list[tuple[Decimal, str | None]], bool]:
        """(parts, whether a unit is stated). Without any number no parts; with a unit that isn't listed, its number without unit."""
        unit, text = (unit or "").strip(), (text or "").strip()
        if value is None:
            for field in (unit, text):
                if parts := self.quantities(field):
                    return parts, True
            if (m := self._front.match(text)) or (m := re.fullmatch(r"\s*([+-]?\d+(?:[.,]\d+)*)\s*()", text)):
                number, stated = decimal_of(m.group(1)), self.unit_of(unit) if unit.lower() not in NO_UNIT else None
                if number is not None and not m.group(2).strip():
                    return [(number, stated)], stated is not None
            return [], False
        if unit.lower() not in NO_UNIT:
            stated = self.unit_of(unit)
            if stated is None and (parts := self.quantities(unit)):
                stated = parts[0][1] if len(parts) == 1 else None
            return [(value, stated)], stated is not None
        if parts := self.quantities(text):
            same = next((u for n, u in parts if n == value), None)
            if same is not None and len(parts) > 1:
                return parts, True
            return [(value, same or parts[0][1])], True
        stated = self.mentioned(text)
        return [(value, stated)], stated is not None

    def common(self, parts: list[tuple[Decimal, str]]) -> tuple[str, int]:
        """(common unit, the sum of the parts there, times 10 to the decimals, rounded half up)."""
        with localcontext() as c:
            c.prec = 60
            one = self.by_unit[parts[0][1]]
            total = sum((n * self.by_unit[u].factor + self.by_unit[u].shift for n, u in parts), Decimal(0))
            scaled = total.scaleb(one.decimals) + Decimal("0.5")
            floor = scaled.to_integral_value(ROUND_DOWN)
            return one.common, int(floor - 1 if floor > scaled else floor)
