"""The rule bank as data: which words each named rule looks for.

Every value is a comma list of whole words or phrases in lower case. The few
spellings no list can hold (an ending of any length, any number of one letter)
stand in ``OPEN_SPELLINGS`` and are used in the lists by their key.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def terms(listed: str) -> tuple[str, ...]:
    return tuple(listed.split(", ")) if listed else ()


def all_terms(table: dict[str, str], *names: str) -> tuple[str, ...]:
    """Terms of the named rules, or of the whole table."""
    return tuple(t for name in (names or table) for t in terms(table[name]))


# Regular expressions on a padded surface.
OPEN_SPELLINGS = {
    "nerz*": r" nerz\w* ",
    "rac+oon": r" rac+oons? ",
}

# Animals whose name alone in a title is enough.
SURE_ANIMALS = {
    "marten": "marten",
    "ermine": "ermine",
    "karakul": "karakul, karacul, carakul, caracul",
    "astrachan": "astrachan, astrakhan",
    "broadtail": "broadtail",
    "orylag": "orylag",
    "nutria": "nutria",
    "muskrat": "muskrat, muskrats",
    "persian_lamb": "persian lamb",
}

# Animals that need a fur term next to them.
AMBIGUOUS_ANIMALS = {
    "mink": "mink, minks",
    "bobcat": "bobcat, bobcats",
    "fox": "fox, foxes",
    "rabbit": "rabbit, rabbits",
    "raccoon": "rac+oon",
    "wolf": "wolf, wolves",
    "squirrel": "squirrel, squirrels",
    "beaver": "beaver, beavers",
    "otter": "otter, otters",
    "badger": "badger, badgers",
    "possum": "possum, possums, opossum, opossums",
    "hamster": "hamster, hamsters",
    "coyote": "coyote, coyotes",
    "chinchilla": "chinchilla, chinchillas",
    "sable": "sable",
    "lynx": "lynx",
    "wolverine": "wolverine, wolverines",
    "fitch": "fitch",
    "polecat": "polecat, polecats",
    "kangaroo": "kangaroo, kangaroos",
    "tanuki": "tanuki",
    "finncoon": "finncoon, finncoons, finn coon, finn coons",
    "weasel": "weasel, weasels",
    "skunk": "skunk, skunks",
    "marmot": "marmot, marmots",
    "stoat": "stoat, stoats",
}

# Garments that follow "fur".
GARMENTS = (
    "coat, jacket, stole, wrap, cape, vest, collar, hat, blanket, throw, ruff, trim, cuff, muff, "
    "boa, shawl, poncho, gilet, bolero, headband, scarf, hood"
)

# Fur terms in title and tags, in the order the context list shows them.
FUR_TERMS = {
    "fur": "fur",
    "pelt": "pelt, pelts",
    "tanned": "tanned",
    "stole": "stole",
    "real fur": "real fur",
    "genuine fur": "genuine fur",
    "natural fur": "natural fur",
    "vintage fur": "vintage fur",
    "knitted fur": "knitted fur",
    "full skin": "full skin",
    "let-out": "let out",
    "skin-on-skin": "skin on skin",
    "fur-lined": "fur lined, furlined",
    "guard hairs": "guard hair, guard hairs",
    "trapped/trapping": "trapped, trapping",
    "fur garment": ", ".join(f"fur {garment}" for garment in terms(GARMENTS)),
    "fur plate": "fur plate, fur plates",
    "auction brand": "blackglama, saga fur, saga furs, kopenhagen fur",
    "non-english fur": "fourrure, pelliccia, nerz*",
    "kangaroo hide/skin": "hide, skin",
    "taxidermy": "taxiderm, taxidermy, taxidermied, taxidermist",
    "specific mount": "shoulder mount, full body mount",
    "study skin": "study skin",
    "skull": "skull",
    "jawbone": "jawbone, jawbones",
    "bone specimen": "bone specimen",
    "claws": "claw, claws",
    "oddities/curiosities": "oddities, curiosities",
    "vulture culture": "vulture culture",
    "sealskin": "sealskin",
    "seal fur/pelt": "seal fur, seal pelt",
}
TAXIDERMY_RULES = (
    "taxidermy",
    "specific mount",
    "study skin",
    "jawbone",
    "bone specimen",
    "vulture culture",
)
SEAL_RULES = ("sealskin", "seal fur/pelt")
HIDE_RULE = "kangaroo hide/skin"
# Shown to the reader of a result, but no evidence of fur.
SHOWN_ONLY_RULES = ("skull", "claws", "oddities/curiosities")

# Words that speak against fur, in the order the negation list shows them.
ANGORA = {"angora": "angora"}
TAG_NEGATION = {"tag_negation": "polyester, poly, acrylic, modacrylic, faux, synthetic, vegan"}
FAUX_WORDS = "faux, synthetic, vegan, fake, imitation, artificial"
TITLE_COUNTERS = {
    "title_negation": FAUX_WORDS,
    "pet_memorial": "memorial, urn, cremation, pet loss, rainbow bridge, in memory",
    "mink_oil": "mink oil",
    "doc_marten": "doc marten, doc martens, dr marten, dr martens, doctor marten, doctor martens",
    "abercrombie_fitch": "abercrombie",
    "van_pelt": "van pelt",
    "sticker_decal": "sticker, stickers, decal, decals",
    "fursuit_title": "fursuit",
}

# What a faux word in a title is near to (singular names only).
FAUX_NEIGHBOURS = (
    "fur, mink, fox, rabbit, chinchilla, sable, beaver, rac+oon, coyote, marten, wolf, lynx, "
    "bobcat, otter, badger, ermine, possum, opossum, muskrat, nutria, squirrel, hamster, "
    "karakul, karacul, carakul, caracul, astrachan, astrakhan, broadtail, orylag, wolverine, "
    "fitch, polecat, persian lamb, kangaroo, tanuki, finn coon, finncoon, weasel, skunk, "
    "marmot, stoat"
)

# Materials and farmed or game animals, shown as context.
MATERIALS = {"wool": "wool", "leather": "leather", "shearling": "shearling", "suede": "suede"}
BYPRODUCTS = {
    "byproduct_animal": (
        "sheep, sheepskin, lamb, lambskin, shearling, toscana, reindeer, cow, cowhide, goat, "
        "goatskin, deer, deerskin, elk, bison, buffalo, alpaca, llama, yak, camel, ostrich, "
        "mouton, horse, horsehide, pig, pigskin, pheasant, pheasants"
    )
}

# Words before "fur" in a description.
DESCRIPTION_FAUX = "faux, fake, synthetic, artificial, imitation"
DESCRIPTION_FAUX_REACTIVATED = "faux, fake, synthetic, artificial costume grade, artificial, imitation"
DESCRIPTION_REAL = "real, genuine"

# Title terms that stand without an animal.
EXPLICIT_CLAIMS = "real fur, genuine fur, natural fur"
PELT_TERMS = "pelt, pelts"
STRONG_TERMS = (
    "real fur, genuine fur, natural fur, vintage fur, knitted fur, full skin, fur plate, "
    "fur plates, blackglama, saga fur, saga furs, kopenhagen fur, fourrure, pelliccia, nerz*"
)
VINTAGE_TERMS = "vintage, antique"

# Real-fur wording in tags that overrides the fursuit exclusion.
FURSUIT_OVERRIDE = (
    r"real[\t\n\f\r ]*fur",
    r"genuine[\t\n\f\r ]*fur",
    r"real[\t\n\f\r ]+pelt",
)

# The candidate filter, as regular expressions on padded words. It
# knows most animals in the singular only, so a plural such as "foxes" needs
# another of these terms beside it.
CANDIDATE_TERMS = (
    "mink, fox, beaver, rac+oons?, chinchilla, sable, marten, coyote, rabbit, lynx, bobcat, "
    "muskrats?, orylag, nutria, otter, badger, ermine, o?possums?, hamster, [ck]ara[ck]ul, "
    "astra[ck]han, broadtail, squirrel, wolf, wolves, wolverines?, fitch, polecats?, "
    "persian lamb, kangaroos?, tanuki, finn ?coons?, weasels?, skunks?, marmots?, stoats?, "
    "sealskin, seal fur, seal pelt, pelts?, tanned, taxiderm, real fur, genuine fur, "
    "natural fur, vintage fur, knitted fur, full skin, let out, skin on skin, fur lined, "
    "fur coat, fur jacket, fur stole, fur wrap, fur cape, fur vest, fur collar, fur hat, "
    "fur blanket, fur throw, fur ruff, fur trim, fur plates?, guard hairs?, blackglama, "
    r"saga furs?, kopenhagen fur, fourrure, pelliccia, nerz\w*"
)

# Category paths.
NOISE_PATH = "stamps_and_seals"
LONE_ANIMAL_PATHS = (
    r"jackets_and_coats|hats_and_caps|raw_materials\.leather|^home_and_living\.floor_and_rugs"
    r"|\.dresses|\.vests|bags_and_purses|accessories\.(?:gloves_and_sleeves|collars|scarves)"
    r"|^weddings"
)
ELECTRONICS_PATHS = r"^electronics_and_accessories"
PICTURE_PATHS = r"^art_and_collectibles\.(?:prints|painting|photography)"
SCULPTURE_PATHS = r"^art_and_collectibles\.sculpture|art_and_collectibles\.collectibles\.figurines"

# Words the title-edit analyses look for in raw titles.
SPECIES_WORDS = ("fox", "mink", "rabbit", "raccoon", "beaver")
FUR_OR_SPECIES_WORDS = ("fur", *SPECIES_WORDS, "pelz")
AUTHENTIC_WORDS = ("real", "genuine")
CLAIM_WORDS = ("real", "genuine", "natural")
EVIDENT_CLAIM_WORDS = ("real", "genuine", "natural", "authentic")


@dataclass(frozen=True)
class Bank:
    """A rule bank for screening; ``rules.table`` reads one from a table.

    Tables map rules to comma lists of terms. Fur terms that are neither of ``hide`` nor seal
    nor shown only are evidence of fur. ``guards`` names the counter that cancels an animal or
    the pelt claim, ``hide`` the animal that a fur term needs, and ``tiers`` the rules that
    the confidence tiers treat apart.
    """

    sure_animals: dict[str, str] = field(default_factory=dict)
    ambiguous_animals: dict[str, str] = field(default_factory=dict)
    fur_terms: dict[str, str] = field(default_factory=dict)
    taxidermy: tuple[str, ...] = ()
    seal: tuple[str, ...] = ()
    shown_only: tuple[str, ...] = ()
    hide: dict[str, str] = field(default_factory=dict)
    excluded: dict[str, str] = field(default_factory=dict)
    tag_negation: dict[str, str] = field(default_factory=dict)
    counters: dict[str, str] = field(default_factory=dict)
    materials: dict[str, str] = field(default_factory=dict)
    byproducts: dict[str, str] = field(default_factory=dict)
    claims: dict[str, str] = field(default_factory=dict)
    faux_near: dict[str, str] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)
    overrides: dict[str, str] = field(default_factory=dict)
    candidates: dict[str, str] = field(default_factory=dict)
    spellings: dict[str, str] = field(default_factory=dict)
    guards: dict[str, str] = field(default_factory=dict)
    tiers: dict[str, str] = field(default_factory=dict)

    @property
    def evidence(self) -> tuple[str, ...]:
        other = (*self.hide, *self.seal, *self.shown_only)
        return tuple(rule for rule in self.fur_terms if rule not in other)

    def claim(self, name: str) -> tuple[str, ...]:
        return terms(self.claims.get(name, ""))

    def tier(self, name: str) -> tuple[str, ...]:
        return tuple(rule for rule, tier in self.tiers.items() if tier == name)


BUILT_IN = Bank(
    sure_animals=SURE_ANIMALS,
    ambiguous_animals=AMBIGUOUS_ANIMALS,
    fur_terms=FUR_TERMS,
    taxidermy=TAXIDERMY_RULES,
    seal=SEAL_RULES,
    shown_only=SHOWN_ONLY_RULES,
    hide={HIDE_RULE: "kangaroo"},
    excluded=ANGORA,
    tag_negation=TAG_NEGATION,
    counters=TITLE_COUNTERS,
    materials=MATERIALS,
    byproducts=BYPRODUCTS,
    claims={"explicit": EXPLICIT_CLAIMS, "pelt": PELT_TERMS, "strong": STRONG_TERMS, "vintage": VINTAGE_TERMS},
    faux_near={"words": FAUX_WORDS, "neighbours": FAUX_NEIGHBOURS},
    descriptions={"faux": DESCRIPTION_FAUX, "faux_reactivated": DESCRIPTION_FAUX_REACTIVATED, "real": DESCRIPTION_REAL},
    overrides={"fursuit": ", ".join(FURSUIT_OVERRIDE)},
    candidates={"candidate": CANDIDATE_TERMS},
    spellings=OPEN_SPELLINGS,
    guards={"marten": "doc_marten", "fitch": "abercrombie_fitch", "pelt": "van_pelt"},
    tiers={"auction brand": "brand", "non-english fur": "foreign", "fox": "prime", "mink": "prime", "rabbit": "sampled"},
)
