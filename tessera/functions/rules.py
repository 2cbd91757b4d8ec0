"""Constant tables of the Georgian rules. Every function that uses one takes it as a parameter."""

from __future__ import annotations

# Whole tokens with their corrections.
TOKEN_FIXES = {
    "საწმელს": "საჭმელს",
    "ველ": "ვერ",
    "მაგლად": "მაგრად",
    "მაგლა": "მაღლა",
    "დაფლინავს": "დაფრინავს",
    "სანაოსნოთ": "სანაოსნოდ",
    "ღმაფთოვანებელი": "აღმაფრთოვანებელი",
}

# Forms that are both right, so that changing one for the other is no correction.
AMBIGUOUS_PAIRS = [("ბავშვს", "ბავშვებს")]

# Letters that speech recognition confuses, and letters that it drops.
CONFUSIONS = {
    "ლ": "ღრნდთ", "ღ": "ლხგჰრ", "რ": "ლნღგ", "წ": "ჭტს", "ჭ": "წჩშ", "გ": "ღკხ", "კ": "გქჰღ", "ბ": "პვ", "პ": "ბფ",
    "ვ": "ბთფ", "დ": "ტთ", "ტ": "დთ", "ს": "შზძ", "შ": "სჩ", "ზ": "სძ", "მ": "ნბ", "ნ": "მრლ", "ფ": "პვ",
    "ქ": "კღ", "ძ": "ზჯ", "ჯ": "ძჭ", "ც": "ხჩ", "ჩ": "ცხ", "ხ": "ცჩ", "ჰ": "ღკ", "ე": "ო",
}
DROPPED_LETTERS = "რლნვმდთს"

# Limits of the variant generators.
MAX_SUBSTITUTIONS, MAX_INSERTIONS, MAX_DELETIONS = 96, 220, 64


def symmetric(table: dict[str, str]) -> dict[str, list[str]]:
    """Both directions of each confusion, alternatives in code-point order."""
    links = {(a, b) for a, bs in table.items() for b in bs if a != b}
    links |= {(b, a) for a, b in links}
    return {a: sorted(b for x, b in links if x == a) for a in sorted({a for a, _ in links})}
