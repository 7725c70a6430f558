"""Vehicle profiles: which road classes they take, and how fast."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, speeds in km/h and road classes of the built-in profiles.
ALIASES = {"car": "car", "driving": "car", "motorcycle": "motorcycle", "moto": "motorcycle", "bicycle": "bicycle", "bike": "bicycle", "cycling": "bicycle", "foot": "foot", "walk": "foot", "walking": "foot", "pedestrian": "foot"}
CAR_KMH = {
    "motorway": 110.0, "motorway_link": 70.0, "trunk": 90.0, "trunk_link": 60.0, "primary": 75.0, "primary_link": 50.0, "secondary": 65.0, "secondary_link": 45.0,
    "tertiary": 55.0, "tertiary_link": 40.0, "unclassified": 40.0, "residential": 30.0, "living_street": 10.0, "service": 20.0, "road": 35.0,
}
CAR_OTHER = 25.0
BIKE_KMH = {
    "cycleway": 22.0, "primary": 16.0, "primary_link": 16.0, "secondary": 16.0, "secondary_link": 16.0, "tertiary": 18.0, "tertiary_link": 18.0, "unclassified": 18.0,
    "residential": 16.0, "living_street": 16.0, "service": 16.0, "road": 16.0, "path": 12.0, "track": 12.0, "bridleway": 12.0,
}
BIKE_OTHER = 14.0
FOOT_KMH = 5.0
BIKE_CLASSES = "primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential living_street service road cycleway path track bridleway".split()
FOOT_CLASSES = "primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential living_street service road footway path pedestrian steps track bridleway cycleway".split()
BONUS = 1.05
BONUS_CLASSES = ["tertiary", "tertiary_link", "unclassified", "residential"]
CLASSES = {"car": list(CAR_KMH), "motorcycle": list(CAR_KMH), "bicycle": BIKE_CLASSES, "foot": FOOT_CLASSES}


def _case(value: Column, table: dict[str, float], other: Column) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(value == k, F.lit(v))
    return out.otherwise(other) if table else other


def accepts(profile: str, highway: Column) -> Column:
    return highway.isin(CLASSES[ALIASES[profile]])


def speed_kmh(profile: str, highway: Column, limit: Column) -> Column:
    """The speed on a class of road; only motor vehicles look at the limit."""
    name = ALIASES[profile]
    if name == "foot":
        return F.lit(FOOT_KMH)
    if name == "bicycle":
        return _case(highway, BIKE_KMH, F.lit(BIKE_OTHER))
    base = F.coalesce(limit, _case(highway, CAR_KMH, F.lit(CAR_OTHER)))
    return base * F.when(highway.isin(BONUS_CLASSES), BONUS).otherwise(1.0) if name == "motorcycle" else base


def metres_per_second(kmh: Column) -> Column:
    return F.greatest(kmh / 3.6, F.lit(0.5))


@dataclass
class CustomProfile:
    """A profile of directives over a built-in base."""

    name: str = "custom"
    base: str | None = None
    speeds: dict[str, float] = field(default_factory=dict)
    allow: dict[str, float | None] = field(default_factory=dict)
    block: list[str] = field(default_factory=list)
    penalties: dict[str, float] = field(default_factory=dict)
    respect_maxspeed: bool = True
    speed_factor: float = 1.0

    @classmethod
    def parse(cls, text: str, name: str = "custom") -> CustomProfile:
        """Reads `key = value` lines; anything unknown is an error that names its line."""
        out = cls(name=name)

        def number(value: str | None) -> float:
            if value is None:
                raise ValueError("a number is needed")
            return float(value)

        for n, raw in enumerate(text.splitlines(), 1):
            head, eq, value = raw.partition("#")[0].partition("=")
            words, value = head.split(), value.strip() if eq else None
            if not words and value is None:
                continue
            try:
                out._directive(words, value, number)
            except (ValueError, KeyError) as why:
                raise ValueError(f"profile line {n}: {why} ({raw!r})") from None
        if out.speed_factor <= 0:
            raise ValueError("speed_factor must be > 0")
        return out

    def _directive(self, words: list[str], value: str | None, number) -> None:
        single = {"name": lambda v: setattr(self, "name", v), "base": lambda v: setattr(self, "base", ALIASES[v]), "speed_factor": lambda v: setattr(self, "speed_factor", number(v))}
        if len(words) == 1 and words[0] == "respect_maxspeed":
            self.respect_maxspeed = value in ("true", "1")
        elif len(words) == 1 and words[0] in single and value is not None:
            single[words[0]](value)
        elif len(words) == 2 and words[0] == "speed":
            self.speeds.setdefault(words[1], number(value))
        elif len(words) == 2 and words[0] == "allow":
            self.allow.setdefault(words[1], None if value is None else number(value))
        elif len(words) == 2 and words[0] == "block" and value is None:
            self.block.append(words[1])
        elif len(words) == 2 and words[0] == "penalty":
            if number(value) <= 0:
                raise ValueError("penalty must be > 0")
            self.penalties.setdefault(words[1], number(value))
        else:
            raise ValueError("unknown directive")

    def accepts(self, highway: Column) -> Column:
        """Blocked classes never; classes with a speed or allowance always; else as the base says."""
        named = highway.isin([*self.speeds, *self.allow]) if self.speeds or self.allow else F.lit(False)
        base = accepts(self.base, highway) if self.base else F.lit(False)
        return ~(highway.isin(self.block) if self.block else F.lit(False)) & (named | base)

    def speed_kmh(self, highway: Column, limit: Column) -> Column:
        """Classes with a speed of their own are capped by the limit; others go as the base goes."""
        limit = limit if self.respect_maxspeed else F.lit(None).cast("double")
        default = _case(highway, CAR_KMH, F.lit(CAR_OTHER))
        named = {k: F.lit(v) for k, v in self.speeds.items()} | {k: default if v is None else F.lit(v) for k, v in self.allow.items() if k not in self.speeds}
        other = speed_kmh(self.base, highway, limit) if self.base else F.least(default, limit)
        out = F
        for k, v in named.items():
            out = out.when(highway == k, F.least(v, limit))  # a null limit is skipped
        return (out.otherwise(other) if named else other) * self.speed_factor / _case(highway, self.penalties, F.lit(1.0))
