"""Parameters of the terrain engine, with their defaults and allowed ranges."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Tile side and neighbour margin in metres, samples per metre.
TILE_SIZE, MIN_MARGIN, CELLS_PER_METRE = 256.0, 14.0, 2
CELL = 1.0 / CELLS_PER_METRE
TILE_PX = int(TILE_SIZE * CELLS_PER_METRE)
#: Line simplification tolerance in metres, side of the preview square in metres.
SIMPLIFY, PREVIEW_SQUARE = 0.1, 480.0
#: LAS classes.
GROUND, WATER = 2, 9


def _between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in [{low}, {high}], not {value}")


@dataclass(frozen=True)
class ContourParams:
    interval: float = 5.0
    algorithm: str = "raw"  # raw, smooth or naive
    steps: int = 0
    energy_weight: float = 0.01
    form_lines: bool = False
    prune: str = "none"  # none, terrain_change or interpolation_error
    prune_threshold: float = 0.8
    error_threshold: float = 0.15
    basemap: bool = False
    basemap_interval: float = 0.5
    knoll_min: float = 10.0
    knoll_max: float = 160.0

    def __post_init__(self) -> None:
        _between("interval", self.interval, 1, 20)
        _between("prune_threshold", self.prune_threshold, 0.05, 5)
        _between("error_threshold", self.error_threshold, 0.01, 5)
        _between("basemap_interval", self.basemap_interval, 0.1, self.interval)
        _between("knoll_min", self.knoll_min, 0, 225)
        _between("knoll_max", self.knoll_max, self.knoll_min, 225)
        if self.algorithm != "raw":
            _between("steps", self.steps, 1, 20)
        if self.algorithm not in ("raw", "smooth", "naive") or self.prune not in ("none", "terrain_change", "interpolation_error"):
            raise ValueError("unknown contour or prune algorithm")


@dataclass(frozen=True)
class VegetationParams:
    green: tuple[float, float, float] = (0.4, 0.6, 0.8)
    weights: tuple[float, float, float] = (0.5, 0.35, 0.15)
    openness: float = 0.01

    def __post_init__(self) -> None:
        for v in (*self.green, *self.weights, self.openness):
            _between("vegetation parameter", v, 0, 1)
        if list(self.green) != sorted(self.green):
            raise ValueError("green thresholds must rise")


@dataclass(frozen=True)
class IntensityFilter:
    low: float = 0.2
    high: float = 0.4
    symbol: str = "BareRock"

    def __post_init__(self) -> None:
        _between("low", self.low, 0, 1)
        _between("high", self.high, self.low + 0.01, 1)


@dataclass(frozen=True)
class BufferRule:
    direction: str = "grow"
    metres: float = 2.0

    def __post_init__(self) -> None:
        _between("metres", self.metres, 1, 50)
        if self.direction not in ("grow", "shrink"):
            raise ValueError("direction is grow or shrink")


@dataclass(frozen=True)
class MapParams:
    scale: int = 15_000
    contour: ContourParams = field(default_factory=ContourParams)
    vegetation: VegetationParams = field(default_factory=VegetationParams)
    cliff: float = 2.5
    water: float = 0.65
    intensity: tuple[IntensityFilter, ...] = ()
    bezier: float | None = 2.0
    buffers: tuple[BufferRule, ...] = ()
    min_size: bool = False

    def __post_init__(self) -> None:
        if self.scale not in (10_000, 15_000):
            raise ValueError("scale is 10000 or 15000")
        _between("cliff", self.cliff, 0.2, 5)
        _between("water", self.water, 0, 1)
        if self.bezier is not None:
            _between("bezier", self.bezier, 0.5, 5)


#: Symbols with their codes, and least area in square metres (or length) at 1:15,000.
AREAS = [
    ("WhiteForest", "405", 64.0), ("RoughOpenLand", "403", 225.0), ("OpenLand", "401", 64.0), ("SandyGround", "213", 225.0), ("BareRock", "214", 225.0),
    ("LightGreen", "406", 225.0), ("MediumGreen", "408", 110.0), ("DarkGreen", "410", 64.0), ("Marsh", "308", 45.0), ("PrivateArea", "520", 225.0),
    ("PavedAreaWithBoundary", "501", 225.0), ("ShallowWaterWithSolidBankLine", "302", 64.0), ("UncrossableWaterWithBankLine", "301", 64.0),
    ("GiganticBoulder", "206", 67.0), ("Building", "521", 56.0),
]
LINES = [("BasemapContour", "101.2", 3.0), ("NegBasemapContour", "101.3", 3.0), ("Contour", "101", 10.0), ("IndexContour", "102", 10.0), ("FormLine", "103", 250.0), ("SmallCrossableWatercourse", "305", 15.0)]
POINTS = [("SlopeLineFormLine", "103.1"), ("SlopeLineContour", "101.1"), ("DotKnoll", "109"), ("ElongatedDotKnoll", "110"), ("UDepression", "111"), ("SmallBoulder", "204"), ("LargeBoulder", "205")]


def changed_steps(old: MapParams | None, new: MapParams, forced: str | None = None) -> set[str]:
    """The steps of a map that a change of parameters makes necessary, and the forced section.

    Without old parameters and after a change of scale contours are made; without old ones the basemap too, if it is wanted.
    """
    out = {forced} if forced else set()
    if old is None:
        return out | {"contours"} | ({"basemap"} if new.contour.basemap else set())
    if old.scale != new.scale:
        return out | {"contours"}
    basemap = lambda p: (p.contour.basemap, p.contour.basemap_interval)
    rest = lambda p: replace(p.contour, basemap=False, basemap_interval=0.5)
    shape = (old.buffers, old.min_size) != (new.buffers, new.min_size)
    if rest(old) != rest(new):
        out.add("contours")
    if basemap(old) != basemap(new):
        out.add("basemap")
    changed = {
        "openness": old.vegetation.openness != new.vegetation.openness,
        "greens": (old.vegetation.green, old.vegetation.weights) != (new.vegetation.green, new.vegetation.weights),
        "cliffs": old.cliff != new.cliff, "water": old.water != new.water, "intensity": old.intensity != new.intensity,
    }
    return out | {step for step, differs in changed.items() if differs or shape}
