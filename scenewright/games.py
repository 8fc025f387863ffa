"""Fixed values of the three supported games.

Tile characters, descriptors, word lists and thresholds in this module are
fixed values: captions only agree with other tools when they are equal.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------- fixed values
PLATFORMER_TILES = {
    "X": ["solid", "ground"],
    "S": ["solid", "breakable"],
    "-": ["passable", "empty"],
    "?": ["solid", "question block", "full question block"],
    "Q": ["solid", "question block", "empty question block"],
    "E": ["enemy", "damaging", "hazard", "moving"],
    "<": ["solid", "top-left pipe", "pipe"],
    ">": ["solid", "top-right pipe", "pipe"],
    "[": ["solid", "left pipe", "pipe"],
    "]": ["solid", "right pipe", "pipe"],
    "o": ["coin", "collectable", "passable"],
    "B": ["Cannon top", "cannon", "solid", "hazard"],
    "b": ["Cannon bottom", "cannon", "solid"],
}

LADDER_TILES = {
    "B": ["solid", "ground"],
    "b": ["solid", "diggable", "ground"],
    ".": ["passable", "empty"],
    "-": ["passable", "climbable", "rope"],
    "#": ["passable", "climbable", "ladder"],
    "G": ["passable", "pickupable", "gold"],
    "E": ["damaging", "enemy"],
    "M": ["passable", "spawn"],
}

DIRECTIONAL_TILES = {
    "P": ["passable", "empty", "spawn"],
    "@": ["null"],
    "-": ["passable", "empty"],
    "~": ["passable", "empty", "water"],
    "#": ["solid", "ground", "wall"],
    "|": ["passable", "climbable"],
    "B": ["solid", "breakable", "penetrable"],
    "t": ["passable", "empty"],
    "A": ["solid", "passable", "penetrable"],
    "M": ["solid", "moving", "penetrable"],
    "D": ["passable", "movable"],
    "W": ["passable", "collectable", "powerup"],
    "w": ["passable", "collectable", "powerup"],
    "L": ["passable", "collectable", "powerup"],
    "l": ["passable", "collectable", "powerup"],
    "+": ["passable", "collectable", "powerup"],
    "*": ["passable", "collectable", "powerup"],
    "U": ["passable", "collectable", "powerup"],
    "Z": ["passable", "collectable", "powerup"],
    "H": ["solid", "hazard"],
    "C": ["passable", "hazard"],
    "p": ["enemy", "damaging", "solid", "moving", "penetrable"],
    "r": ["enemy", "damaging", "ranged"],
    "q": ["enemy", "damaging", "jumping"],
    "o": ["enemy", "damaging", "spawner"],
    "k": ["enemy", "damaging", "spawner"],
    "j": ["enemy", "damaging", "flying"],
    "g": ["enemy", "damaging"],
    "c": ["enemy", "damaging", "ranged"],
    "e": ["enemy", "damaging", "ranged"],
    "m": ["enemy", "damaging", "jumping"],
    "i": ["enemy", "damaging", "ranged"],
    "^": ["enemy", "damaging"],
    "<": ["enemy", "damaging"],
    "f": ["enemy", "damaging", "jumping"],
    "b": ["enemy", "damaging", "flying"],
    "a": ["enemy", "damaging", "ranged"],
    "d": ["enemy", "damaging", "ranged"],
    "h": ["enemy", "damaging", "ranged"],
}

QUANTITY_TERMS = ["one", "two", "a few", "several", "many"]
DIRECTIONAL_QUANTITY_TERMS = QUANTITY_TERMS + ["some", "half", "mostly", "all"]

PLATFORMER_TOPICS = [
    "floor", "ceiling", "broken pipe", "upside down pipe", "pipe", "coin line", "coin",
    "platform", "tower", "broken cannon", "cannon", "ascending staircase",
    "descending staircase", "rectangular", "irregular", "question block", "loose block", "enem",
]
LADDER_TOPICS = [
    "floor", "gold line", "gold", "ladder cluster", "lone ladder tile", "short ladder",
    "tall ladder", "chamber", "rope", "rectangular", "irregular", "loose block",
    "diggable ground", "solid ground", "background area", "enem",
]
DIRECTIONAL_TOPICS = [
    "powerup", "enem", "hazard", "dissapearing block", "water", "moving platform", "platform",
    "ladder", "loose block", "ceiling", "floor", "wall",
]

# Ordered rewrites that turn bare topic names into absence phrases.
PLATFORMER_NEGATED = [
    (" broken pipe.", ""), ("broken pipe. ", ""), (" broken cannon.", ""), ("broken cannon. ", ""),
    ("pipe", "pipes"), ("cannon", "cannons"), ("platform", "platforms"), ("tower", "towers"),
    ("staircase", "staircases"), ("enem", "enemies"),
    ("rectangular", "rectangular block clusters"), ("irregular", "irregular block clusters"),
    ("coin line", "coin lines"), ("coin.", "coins."),
    ("question block", "question blocks"), ("loose block", "loose blocks"),
]
BROKEN_TOPIC_COUNT = 2

# Phrases a caption generator may use, by topic, and the phrase for absence.
PLATFORMER_PHRASES = {
    "floor": ["full floor", "floor with one gap", "floor with two gaps", "floor with a few gaps",
              "floor with several gaps", "giant gap with one chunk of floor",
              "giant gap with two chunks of floor", "giant gap with a few chunks of floor",
              "giant gap with several chunks of floor"],
    "ceiling": ["full ceiling", "ceiling with one gap", "ceiling with two gaps",
                "ceiling with a few gaps"],
    "upside down pipe": ["one upside down pipe", "two upside down pipes",
                         "a few upside down pipes", "several upside down pipes"],
    "pipe": ["one pipe", "two pipes", "a few pipes", "several pipes"],
    "coin line": ["one coin line", "two coin lines", "a few coin lines"],
    "coin": ["one coin", "two coins", "several coins", "a few coins", "many coins"],
    "platform": ["one platform", "two platforms", "a few platforms", "several platforms"],
    "tower": ["one tower", "two towers", "a few towers"],
    "cannon": ["one cannon", "two cannons", "a few cannons"],
    "ascending staircase": ["one ascending staircase", "two ascending staircases"],
    "descending staircase": ["one descending staircase", "two descending staircases"],
    "rectangular": ["one rectangular block cluster", "two rectangular block clusters",
                    "a few rectangular block clusters"],
    "irregular": ["one irregular block cluster", "two irregular block clusters",
                  "a few irregular block clusters"],
    "question block": ["one question block", "two question blocks", "several question blocks",
                       "a few question blocks", "many question blocks"],
    "loose block": ["one loose block", "two loose blocks", "several loose blocks",
                    "a few loose blocks", "many loose blocks"],
    "enem": ["one enemy", "two enemies", "a few enemies", "several enemies"],
}
PLATFORMER_ABSENT = {
    "floor": "no floor", "ceiling": "no ceiling", "upside down pipe": "no upside down pipes",
    "pipe": "no pipes", "coin line": "no coin lines", "coin": "no coins",
    "platform": "no platforms", "tower": "no towers", "cannon": "no cannons",
    "ascending staircase": "no ascending staircases",
    "descending staircase": "no descending staircases",
    "rectangular": "no rectangular block clusters", "irregular": "no irregular block clusters",
    "question block": "no question blocks", "loose block": "no loose blocks",
    "enem": "no enemies",
}

# Two-sided 95 % t quantiles (0.975), degrees of freedom 1 to 30.
T_975 = [
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851,
    2.364624252, 2.306004135, 2.262157163, 2.228138852, 2.200985160, 2.178812830,
    2.160368656, 2.144786688, 2.131449546, 2.119905299, 2.109815578, 2.100922040,
    2.093024054, 2.085963447, 2.079613845, 2.073873068, 2.068657610, 2.063898562,
    2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
]
# ------------------------------------------------------------ end fixed values


@dataclass(frozen=True)
class Game:
    """A game as data: tiles, scene size, topics and quantity words."""

    name: str
    tiles: dict[str, list[str]]
    height: int
    width: int
    ceiling: int
    topics: list[str]
    quantity_terms: list[str]
    sorted_ids: bool = True
    integer_thirds: bool = False
    phrases: dict[str, list[str]] = field(default_factory=dict)
    absent: dict[str, str] = field(default_factory=dict)

    @property
    def alphabet(self) -> str:
        """Tile characters in id order: code point order, or as listed."""
        chars = list(self.tiles)
        return "".join(sorted(chars) if self.sorted_ids else chars)

    def having(self, *descriptors: str, without: tuple[str, ...] = ()) -> str:
        """Characters that carry any of the descriptors and none of ``without``."""
        return "".join(
            ch for ch in self.alphabet
            if any(d in self.tiles[ch] for d in descriptors)
            and not any(d in self.tiles[ch] for d in without)
        )

    def thirds(self) -> tuple[float, float, float, float]:
        """Column limits (left, right) and row limits (top, bottom) of the thirds."""
        floor = self.height - 1
        if self.integer_thirds:
            left = self.width // 3
            span = (floor - self.ceiling) // 3
        else:
            left = self.width / 3
            span = (floor - self.ceiling) / 3
        return left, self.width - left, self.ceiling + span, floor - span


PLATFORMER = Game("platformer", PLATFORMER_TILES, 16, 16, 4, PLATFORMER_TOPICS, QUANTITY_TERMS,
                  phrases=PLATFORMER_PHRASES, absent=PLATFORMER_ABSENT)
LADDER = Game("ladder", LADDER_TILES, 32, 32, 1, LADDER_TOPICS, QUANTITY_TERMS,
              integer_thirds=True)
DIRECTIONAL = Game("directional", DIRECTIONAL_TILES, 14, 16, 2, DIRECTIONAL_TOPICS,
                   DIRECTIONAL_QUANTITY_TERMS, sorted_ids=False)
GAMES = {g.name: g for g in (PLATFORMER, LADDER, DIRECTIONAL)}
