"""Parameters of the engine. Word lists are configuration: a corpus on another subject brings its own."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChunkSpec:
    words: int = 800
    overlap: int = 120

    def __post_init__(self) -> None:
        if self.words <= 0:
            raise ValueError("chunk_words must be positive")
        if not 0 <= self.overlap < self.words:
            raise ValueError("overlap_words must be at least 0 and less than chunk_words")

    @property
    def step(self) -> int:
        return self.words - self.overlap


@dataclass(frozen=True)
class Profile:
    name: str = "default"
    top_k: int = 8
    candidate_k: int = 40
    skip_rerank: bool = False

    @property
    def branch_limit(self) -> int:
        """Rows each branch gives to the fusion."""
        return max(2 * self.candidate_k, 24)


PROFILES = {p.name: p for p in (Profile(), Profile("fast", 4, 12, True), Profile("deep", 10, 60, False))}


def profile(fast: bool = False, deep: bool = False) -> Profile:
    if fast and deep:
        raise ValueError("choose one of fast and deep")
    return PROFILES["fast" if fast else "deep" if deep else "default"]


@dataclass(frozen=True)
class Weights:
    semantic: float = 0.35
    lexical: float = 0.45
    boost: float = 0.20


# The word lists below are what scores and rules are defined over.
SECTION_TERMS = (
    "prva glava", "druga glava", "treca glava", "cetvrta glava", "peta glava", "sesta glava", "sedma glava", "osma glava",
    "deveta glava", "deseta glava", "jedanaesta glava", "dvanaesta glava", "predgovor", "rijec autora", "uvodne napomene", "sadrzaj",
)
STRUCTURE_TERMS = (
    "osnivanje", "formiranje", "brigada", "stab", "staba", "komanda", "komandant", "komesara", "komesar", "bataljon", "ceta",
    "divizije", "korpusa",
)
CHRONOLOGY_TERMS = (
    "1941", "1942", "1943", "1944", "1945", "oktobra", "septembra", "januara", "marta", "aprila", "maja", "juna", "jula",
    "augusta", "novembra", "decembra",
)
OPERATIONAL_TERMS = (
    "napad", "borba", "borbe", "dejstva", "operacija", "oslobodenje", "oslobodenja", "desant", "iskrcavanje", "odbrana", "obrana",
    "prodor", "povlacenje", "evakuacija", "evakuirane", "vis", "brac", "korcula", "peljesac", "split", "sibenik", "knin",
    "mostar", "bihac", "gospic", "krk", "trst", "celovec",
)
LOCATION_STEMS = (
    "vis", "brac", "korcula", "peljesac", "split", "sibenik", "knin", "mostar", "bihac", "gospic", "krk", "trst", "celovec",
    "istra", "sloven", "biokov",
)
EXPANSIONS = {
    "osnovana": ("osnivanje", "formiranje", "formirana", "postrojili", "postrojavanje"),
    "osnovan": ("osnivanje", "formiranje", "formiran"),
    "osnivanje": ("osnovana", "formiranje", "formirana", "postrojavanje"),
    "formirana": ("formiranje", "osnovana", "osnivanje", "postrojavanje"),
    "formiran": ("formiranje", "osnovan", "osnivanje"),
    "formiranje": ("formirana", "osnivanje", "osnovana", "postrojavanje"),
    "brigada": ("brigade", "biokovske", "biokovska"),
    "where": ("gdje", "kozici", "biokovu"),
    "when": ("kada", "oktobra", "listopada"),
    "formed": ("formirana", "formiranje", "osnovana", "osnivanje"),
    "founded": ("osnovana", "osnivanje", "formirana", "formiranje"),
    "established": ("osnovana", "osnivanje", "formirana", "formiranje"),
}
INTENT_TERMS = {
    "formation": (
        "osnovana", "osnovan", "osnivanje", "formirana", "formiran", "formiranje", "postrojavanje", "postrojili", "founded",
        "formed", "established",
    ),
    "chronology": (
        "kada", "when", "timeline", "chronology", "tokom", "nakon", "prije", "1941", "1942", "1943", "1944", "1945",
    ),
    "command": (
        "komandant", "komandanti", "komesar", "komesari", "stab", "staba", "command", "commander", "staff",
    ),
    "structure": (
        "brigada", "bataljon", "bataljona", "ceta", "cete", "odred", "divizija", "divizije", "korpus", "korpusa", "sastav",
        "structure", "unit", "organization",
    ),
    "campaign": (
        "napad", "napadi", "borba", "borbe", "bitka", "bitke", "operacija", "operacije", "dejstva", "pokret", "kretanje",
        "movement", "movements", "location", "locations", "battle", "battles", "campaign", "campaigns", "assault", "attack",
        "attacks", "incursion", "evacuated", "evacuation", "desant", "iskrcavanje", "oslobodenje", "oslobadanje", "advance",
        "advancee", "vis", "brac", "korcula", "peljesac", "split", "sibenik", "knin", "mostar", "bihac", "gospic", "krk",
        "trst", "istria", "istra", "slovenia", "sloveniji",
    ),
}
INTENT_SUBSTRINGS = {"brach_topic": ("brac",)}

#: (intent, what must hold, by how much): a feature's name, "not " and one, or "text:" and words joined by "|".
BOOSTS = (
    ("formation", "has_section_heading", 0.35), ("formation", "is_early_section", 0.45), ("formation", "has_structure_terms", 0.25),
    ("formation", "text:kozic|biokov", 0.5),
    ("chronology", "has_chronology_terms", 0.35), ("chronology", "is_early_section", 0.2), ("chronology", "is_contents", 0.25),
    ("command", "has_structure_terms", 0.35), ("command", "is_appendix_like", 0.2), ("command", "text:komand|komesar", 0.35),
    ("structure", "has_structure_terms", 0.35), ("structure", "is_contents", 0.25), ("structure", "has_section_heading", 0.15),
    ("campaign", "has_operational_terms", 0.55), ("campaign", "has_section_heading", 0.15), ("campaign", "not is_appendix_like", 0.15),
    ("campaign", "is_appendix_like", -0.35), ("campaign", "looks_list_like", -0.15), ("campaign", "text:" + "|".join(LOCATION_STEMS), 0.2),
    ("brach_topic", "text:brac", 0.5), ("brach_topic", "text:desant|napad", 0.3),
    ("", "is_contents", 0.05),
)


@dataclass(frozen=True)
class Vocabulary:
    section: tuple[str, ...] = SECTION_TERMS
    structure: tuple[str, ...] = STRUCTURE_TERMS
    chronology: tuple[str, ...] = CHRONOLOGY_TERMS
    operational: tuple[str, ...] = OPERATIONAL_TERMS
    contents: tuple[str, ...] = ("sadrzaj", "strana")
    expansions: dict[str, tuple[str, ...]] = field(default_factory=lambda: EXPANSIONS)
    intents: dict[str, tuple[str, ...]] = field(default_factory=lambda: INTENT_TERMS)
    intent_substrings: dict[str, tuple[str, ...]] = field(default_factory=lambda: INTENT_SUBSTRINGS)
    boosts: tuple[tuple[str, str, float], ...] = BOOSTS
    distinct_hits: int = 3
    early_until: int = 80
    appendix_from: int = 470
    list_marks: int = 8
    list_window: int = 1200


# Markers of the event rules, as substrings of normalised text.
COMBAT = (
    "battle", "combat", "fighting", "fight", "raid", "assault", "attack", "counterattack", "landing", "landed", "repulse",
    "repelled", "defen", "offensive", "operation", "liberation", "capture", "captured", "ambush", "skirmish", "napad", "borba",
    "borbe", "desant", "iskrc", "odbran", "oslobod", "protivnapad", "prepad", "juris",
)
EXCLUDED = (
    "meeting", "staff established", "headquarters", "command handover", "appointed brigade commander", "replaced by",
    "reorganisation of", "reorganization of", "redesignated", "organisation of island defences",
    "organization of island defences", "administrative order", "order of the", "order issued by", "directive",
    "staff with seat", "formed the 26th division", "formation of 26th division", "meeting of coastal command",
    "battalion into four companies", "strength report", "disposition report", "operational hq established",
    "dressing station", "hospital", "headquarters established", "deputy commander",
)
ADMINISTRATIVE = (
    "handover", "appointed", "seat in", "staff", "meeting", "reorganisation", "reorganization", "redesignation", "redesignated",
    "directive", "order", "hospital", "strength", "disposition", "redistribution",
)
NON_COMBAT = (
    "deployment", "deployed to", "transfer to mainland", "transfer to the mainland", "transferred to", "relocation",
    "concentration of", "strength report", "disposition", "reserve", "withdrawn from", "stationed at", "holding positions",
    "evacuated", "embarked", "return to", "march to",
)
MOVEMENT_TITLES = (
    "rotation of", "returned to", "return to", "withdrawal to", "withdrawn to", "withdrawn from", "transported by",
    "transferred to", "transfer to", "deployment to", "deployed to", "concentration of", "relocation", "redistribution",
    "holding positions", "reserve", "organis", "organiz",
)
MOVEMENT_PREFIXES = (
    "units of", "returned to", "return to", "withdrawal to", "withdrawn to", "withdrawn from", "rotation of", "transported by",
    "moved from", "movement from", "transfer to", "transferred to", "deployed in", "deployed to", "concentration of",
)
TITLE_PATTERNS = (
    r"^(?:\d+(?:st|nd|rd|th)\s+)?(?:battalion|company|platoon|patrol)\b.*\b(transported|moved|returned|withdrawn|deployed|transferred|evacuated|embarked|marched)\b",
    r"^(?:units of|evacuation of|movement of|transfer of|withdrawal of|withdrawal to|return from|return to)\b",
    r"^(?:brigade|units)\b.*\b(returned|withdrawn|evacuated|moved|transported|transferred)\b",
)
SMALL_UNITS = ("battalion", "bataljon", "company", "ceta", "platoon", "vod", "patrol", "patrola")
UNIT_MOVES = (
    "deploy", "deployed", "deployment", "withdrawn", "withdrew", "transfer", "transferred", "return", "returned", "embark",
    "embarked", "disposition", "reserve", "concentrat", "relief", "redistribution", "march", "movement", "position",
    "holding positions", "stationed", "garrisoned",
)
FORMED = ("formation", "formiranje")
REORGANISED = ("reorganisation", "reorganization", "redesignated")
BRIGADE, DIVISION = ("brigade", "brigada"), ("division", "divizija")
OTHER_FORMATION = ("redesignated", "redesignation", "formation of 26th division", "formed the 26th division")
CASUALTIES = "casualt"
PLACE_STOPWORDS = ("island", "otok", "area", "near", "sector", "coast", "mainland", "the", "and", "of", "at")


@dataclass(frozen=True)
class EventRules:
    combat: tuple[str, ...] = COMBAT
    excluded: tuple[str, ...] = EXCLUDED
    administrative: tuple[str, ...] = ADMINISTRATIVE
    non_combat: tuple[str, ...] = NON_COMBAT
    movement_titles: tuple[str, ...] = MOVEMENT_TITLES
    movement_prefixes: tuple[str, ...] = MOVEMENT_PREFIXES
    title_patterns: tuple[str, ...] = TITLE_PATTERNS
    small_units: tuple[str, ...] = SMALL_UNITS
    unit_moves: tuple[str, ...] = UNIT_MOVES
    place_stopwords: tuple[str, ...] = PLACE_STOPWORDS
    place_ratio: float = 0.82
    text_ratio: float = 0.55
