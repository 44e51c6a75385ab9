"""Listing texts for the stand-in tables, one per case the rules tell apart."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    title: str | None
    tags: str | None = None
    description: str | None = None
    full_path: str | None = None
    top_category: str | None = None


T = Template
TEMPLATES = (
    T("Real Fox Fur Coat", "winter, coat", None, "clothing.jackets_and_coats", "clothing"),
    T("Real Fur Coat", "warm", None, "clothing.jackets_and_coats", "clothing"),
    T("Faux Fox Fur Hat", "hat", None, "accessories.hats_and_caps", "accessories"),
    T("Vegan Leather Fox Bag", "bag", None, "bags_and_purses.totes", "bags_and_purses"),
    T("Synthetic Large Grey Fox Fur Tail", "tail", None, "toys.costumes", "toys"),
    T("Fox Fur Hat", "polyester, winter", None, "accessories.hats_and_caps", "accessories"),
    T("Fox Fur Hat", "winter", "It is made of faux fur.", "accessories.hats_and_caps", "accessories"),
    T("Fox Fur Hat", "hat", "This is not faux fur, it is real fur", "accessories.hats_and_caps", "accessories"),
    T("Angora Rabbit Fur Hat", None, None, "accessories.hats_and_caps", "accessories"),
    T("Rabbit Urn Memorial", "fur, keepsake", None, "home_and_living.urns", "home_and_living"),
    T("Fox Sticker", "fur", None, "paper.stickers", "paper_and_party_supplies"),
    T("Wolf Fursuit Tail", "fur", None, "toys.costumes", "toys"),
    T("Wolf Fursuit Tail", "real fur, handmade", None, "toys.costumes", "toys"),
    T("Fox Taxidermy Mount", "shoulder mount", None, "home_and_living.decor", "home_and_living"),
    T("Fox Pelt Taxidermy", None, None, "home_and_living.decor", "home_and_living"),
    T("Marten Pelt", "trapped, tanned", None, "craft_supplies_and_tools.raw", "craft_supplies_and_tools"),
    T("Vintage Ermine Cape", None, None, "clothing.jackets_and_coats", "clothing"),
    T("Vintage Ermine Cape", None, None, "jewelry.necklaces", "jewelry"),
    T("Rabbit Fur Scarf", None, None, "clothing.scarves", "clothing"),
    T("Rabbit Fur Scarf", None, None, "home_and_living.decor", "home_and_living"),
    T("Raccoon Fur Trim Hood", None, None, "craft_supplies_and_tools.trim", "craft_supplies_and_tools"),
    T("Racccoons Fur Trim Hood", "coat", None, "toys.costumes", "toys"),
    T("Sealskin Boots", "seal fur", None, "clothing.shoes", "clothing"),
    T("Vintage Fur Collar", None, None, "accessories.collars", "accessories"),
    T("Vintage Fur Sheepskin Collar", "shearling, suede", None, "accessories.collars", "accessories"),
    T("Real Fur Sheepskin Rug", "wool", None, "home_and_living.floor_and_rugs", "home_and_living"),
    T("Doc Marten Leather Boots", "leather", None, "clothing.shoes", "clothing"),
    T("Abercrombie Fitch Fur Vest", None, None, "clothing.vests", "clothing"),
    T("Van Pelt Print", None, None, "art_and_collectibles.prints", "art_and_collectibles"),
    T("Kangaroo Hide Rug", None, None, "toys.other", "toys"),
    T("Fox Hide Rug", "skin", None, "home_and_living.floor_and_rugs", "home_and_living"),
    T("Blackglama Mink Coat", None, None, "clothing.jackets_and_coats", "clothing"),
    T("Nerzmantel", "pelliccia", None, "clothing.jackets_and_coats", "clothing"),
    T("Two Minks", None, None, "art_and_collectibles.drawing", "art_and_collectibles"),
    T("Minks Fur Coat", None, None, "clothing.jackets_and_coats", "clothing"),
    T("Mink Fur Picture", None, None, "art_and_collectibles.prints", "art_and_collectibles"),
    T("Mink Fur Figure", None, None, "art_and_collectibles.sculpture", "art_and_collectibles"),
    T("Real Fur Figure", None, None, "art_and_collectibles.sculpture", "art_and_collectibles"),
    T("Mink Fur Case", None, None, "electronics_and_accessories.cases", "electronics_and_accessories"),
    T("Fox Fur Wax Seal", None, None, "craft.Stamps_and_Seals", "craft_supplies_and_tools"),
    T(None, "mink fur", None, "clothing.other", "clothing"),
    T("Foxes Fur Coat", None, None, "toys.other", "toys"),
    T("Upcycled Tail", "costume", None, "accessories.costume", "accessories"),
    T("Natural Collar", None, None, "accessories.collars", "accessories"),
    T("Wool Hat", "wool", None, "accessories.hats_and_caps", "accessories"),
    T("Faux Collar", "collar", None, "accessories.collars", "accessories"),
    T("Genuine Bag", None, None, "bags_and_purses.totes", "bags_and_purses"),
    T("Pelzé Mütze mit Pelz", "pelz", None, "accessories.hats_and_caps", "accessories"),
    T("Collar: Fox, Mink", "genuine fur, natural fur", None, "accessories.collars", "accessories"),
    T("Foxé Mink–Real\tFur", "acrylic-knit", "Artificial costume grade fur; (genuine  fur)", "clothing.other", "clothing"),
    T(
        "Karakul Astrakhan Broadtail Persian Lamb Stole",
        "knitted fur, let out, skin on skin, fur-lined, furlined, guard hairs",
        "artificial costume grade fur",
        "weddings.shawls",
        "weddings",
    ),
    T("Caracul Orylag Nutria Muskrats", "full skin, fur plates, saga furs", None, "clothing.dresses", "clothing"),
    T(
        "Bobcat Squirrel Beavers Otter Badger Opossum Hamster Coyotes",
        "oddities, skull, claws, jawbone, bone specimen, study skin",
        None,
        "home_and_living.decor",
        "home_and_living",
    ),
    T(
        "Chinchilla Sable Lynx Wolverine Polecat Tanuki Finn Coon Pelts",
        "vulture culture, full body mount, kopenhagen fur, fourrure",
        None,
        "craft_supplies_and_tools.raw",
        "craft_supplies_and_tools",
    ),
    T("Finncoon Weasels Skunk Marmots Stoat Wolves Fur Throw", None, None, "home_and_living.throws", "home_and_living"),
    T("Mink Oil Vinyl Decal", "curiosities", None, "home_and_living.care", "home_and_living"),
    T("Imitation of a Kangaroo Skin", "skin", "Fake fur. Genuine fur lining!", "toys.other", "toys"),
    T("Authentic Real Rabbit Pelt Taxidermy Costume", "real pelt", None, "toys.costumes", "toys"),
    T("Shearling Trim Real Beaver Collar", None, "genuine\nfur, never synthetic   fur", "accessories.collars", "accessories"),
    T("Antique Fur Muff", "furs", None, "accessories.gloves_and_sleeves", "accessories"),
    T("Blue Ceramic Mug", "mug, gift", None, "home_and_living.kitchen", "home_and_living"),
    T("Silver Ring", None, None, "jewelry.rings", "jewelry"),
    T("Saga Fur Fox Vest", None, None, "clothing.vests", "clothing"),
    T("Dr Martens Genuine Fur Lined Boots", None, None, "clothing.shoes", "clothing"),
    T("Mink Pelz Jacke", "jacke", "Wir verkaufen faux-fur", "clothing.jackets_and_coats", "clothing"),
)
