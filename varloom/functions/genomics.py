"""Scalar expressions on sites, alleles and copy numbers: columns in, columns out, all in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Event classes, and those that are copy-number events.
EVENTS = ("HETGermline", "HETSomatic", "LOH", "cnLOH", "GainSomatic", "GainGermline", "DELHom", "Noise", "Ignored")
CN_EVENTS = ("LOH", "cnLOH", "GainSomatic", "GainGermline")
#: Mutation types by their printed names.
MUTATION_TYPES = (
    "nonsynonymous_SNV", "synonymous_SNV", "stopgain_SNV", "stoploss_SNV", "splicing", "UTR3", "UTR5", "intronic",
    "intergenic", "upstream", "downstream", "upstream;downstream", "ncRNA_exonic", "ncRNA_intronic", "ncRNA_splicing",
    "ncRNA_UTR3", "ncRNA_UTR5", "exonic-orf-err",
)
#: Chromosome lengths (build 38) and lengths of the short arm, codes 1..22, 23 = X, 24 = Y, 25 = M.
CHROM_LENGTHS = (
    248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422,
    135086622, 133275309, 114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167,
    46709983, 50818468, 156040895, 57227415, 0,
)
SHORT_ARMS = (
    125000000, 93300000, 91000000, 50400000, 48400000, 61000000, 59900000, 45600000, 49000000, 40200000,
    53700000, 35800000, 17900000, 17600000, 19000000, 36600000, 24000000, 17200000, 26500000, 27500000,
    13200000, 14700000, 60600000, 12500000, 0,
)
NOVEL, UNKNOWN_RS = -5, -1


def _lookup(pairs: dict, key: Column, default: Column | None = None) -> Column:
    """A small table as a literal map, so that the key is computed once."""
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def chrom_code(name: Column) -> Column:
    """Chromosome name to 0..25 (X 23, Y 24, M 25); null when it is none."""
    # a name that doesn't match stays as it is, and so is in no table
    bare = F.regexp_replace(F.lower(F.trim(name)), r"^(?:chr_|chr|c)?(?:0*([0-9]+)|(x|y|m).*)\z", "$1$2")
    return _lookup({**{str(i): i for i in range(26)}, "x": 23, "y": 24, "m": 25}, bare)


def chrom_dim(spark: SparkSession) -> DataFrame:
    """code, length, p_arm and ``offset``, the genome-wide position before the chromosome. 25 rows."""
    rows, offset = [], 0
    for i, (length, arm) in enumerate(zip(CHROM_LENGTHS, SHORT_ARMS), 1):
        rows.append((i, length, arm, offset))
        offset += length
    return spark.createDataFrame(rows, "code int, length bigint, p_arm bigint, offset bigint")


def with_genome_position(df: DataFrame, code: str, pos: str, out: str = "genome_pos") -> DataFrame:
    """Position over all chromosomes laid end to end."""
    dim = chrom_dim(df.sparkSession).select(F.col("code").alias("__code"), F.col("offset").alias("__offset"))
    return df.join(F.broadcast(dim), F.col(code) == F.col("__code"), "left").withColumn(
        out, F.col(pos) + F.col("__offset")).drop("__code", "__offset")


def arm(code: Column, pos: Column) -> Column:
    """p or q by the length of the short arm."""
    lengths = F.array(*[F.lit(x) for x in SHORT_ARMS])
    return F.when(pos >= F.try_element_at(lengths, code), "q").when(code.between(1, 25) & pos.isNotNull(), "p")


def vaf(var: Column, total: Column) -> Column:
    """Variant allele fraction; null without coverage."""
    return F.try_divide(var.cast("double"), total.cast("double"))


def vaf_from_raw(platform: Column, illumina: Column, solid_var: Column, solid_total: Column) -> Column:
    """Fraction by platform: given as such, or variant over total reads."""
    return F.when(F.lower(platform) == "solid", vaf(solid_var, solid_total)).otherwise(illumina.cast("double"))


def is_homozygous(var: Column, total: Column) -> Column:
    """All reads or none carry the variant."""
    return (var == total) | (var == 0)


def gc_fraction(flank: Column) -> Column:
    """G and C over valid letters of a flank; -1 without valid letters, null for null."""
    valid = F.length(F.regexp_replace(flank, "[^ACGTNacgtn]", ""))
    return F.when(valid == 0, F.lit(-1.0)).otherwise(F.length(F.regexp_replace(flank, "[^GCgc]", "")) / valid)


def rs_text(field: Column) -> Column:
    """The first ``rs`` with its digits (or -1); empty when there is none."""
    return F.regexp_extract(field, r"rs(-1|[0-9]*)", 0)


def rs_number(field: Column) -> Column:
    """Identifier's number; -5 for novel, -1 when unknown."""
    digits = F.regexp_extract(field, "rs([0-9]+)", 1)
    return F.when(F.lower(field).contains("novel"), NOVEL).when(digits != "", digits.try_cast("bigint")).otherwise(UNKNOWN_RS)


def population_frequency_class(dbsnp: Column, ref: Column) -> Column:
    """Novel, Rare (lowest frequency below 1 %), Common or Unknown, from the third comma item's allele|share pairs."""
    items = F.split(dbsnp, ",")
    pairs = F.transform(F.split(F.get(items, F.lit(2)), ";"), lambda p: F.struct(
        F.get(F.split(p, r"\|"), F.lit(1)).try_cast("double").alias("f"), F.get(F.split(p, r"\|"), F.lit(0)).alias("a")))
    lowest = F.array_min(F.filter(pairs, lambda p: p["f"].isNotNull()))
    share = F.when(lowest["a"] == ref, 1 - lowest["f"]).otherwise(lowest["f"])
    return (F.when(F.lower(F.trim(dbsnp)) == "novel", "Novel").when((F.size(items) <= 2) | share.isNull() | dbsnp.isNull(), "Unknown")
            .when(share < 0.01, "Rare").otherwise("Common"))


def nucleotide(allele: Column) -> Column:
    """A, C, G, T, or N for anything else and for missing."""
    up = F.upper(F.trim(allele))
    return F.when(up.isin("A", "C", "G", "T"), up).otherwise("N")


def complement(alleles: Column) -> Column:
    return F.translate(alleles, "ACGTacgt", "TGCAtgca")


def mutation_type(name: Column) -> Column:
    """Known mutation type in its printed spelling, else None."""
    return _lookup({m.lower(): m for m in MUTATION_TYPES}, F.lower(F.trim(name)), F.lit("None"))


def gene_name(name: Column) -> Column:
    """Gene without its distance; null for missing."""
    trimmed = F.trim(name)
    return F.when(~trimmed.isin("", "."), F.when(trimmed.contains("dist"), F.substring_index(trimmed, "(", 1)).otherwise(trimmed))


def nearest_5(n: Column) -> Column:
    """Nearest multiple of 5, halves up (also below zero)."""
    return (F.floor(n / 5.0 + 0.5) * 5).cast("bigint")


def round_to_power(n: Column, power: int) -> Column:
    """Nearest multiple of 10^power, halves up."""
    return F.floor(n / F.lit(10.0**power) + 0.5) * F.lit(10.0**power)


def significant(x: Column, figures: int) -> Column:
    """``x`` to so many significant figures."""
    scale = F.pow(F.lit(10.0), F.lit(figures) - F.ceil(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def safe_log10(x: Column) -> Column:
    return F.when(x == 0, -50.0).otherwise(F.log10(x))


def log_or_zero(x: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(F.ln(x))


def log_add(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log10_add(a: Column, b: Column) -> Column:
    """log10(10^a + 10^b) without overflow."""
    return F.greatest(a, b) + F.log1p(F.pow(F.lit(10.0), -F.abs(a - b))) / F.ln(F.lit(10.0))


def copy_number_class(cn: Column, hom: float = 1.1, deletion: float = 1.8, gain: float = 2.2) -> Column:
    """homdel, del, amp or diploid."""
    return F.when(cn <= hom, "homdel").when(cn <= deletion, "del").when(cn >= gain, "amp").when(cn.isNotNull(), "diploid")


def purity_mix(purity: Column, cn: Column, stroma: Column | None = None) -> Column:
    """Copy number seen at a purity: purity * cn + (1 - purity) * stroma (2 unless given)."""
    return purity * cn + (1 - purity) * (F.lit(2.0) if stroma is None else stroma)


def purity_from_vaf(v: Column, neutral: bool) -> Column:
    """Purity from a fraction's larger side: 2v - 1 for copy-neutral loss, (2v - 1) / v for loss."""
    big = F.greatest(v, 1 - v)
    return 2 * big - 1 if neutral else (2 * big - 1) / big


def on_diagonal(x: Column, y: Column, leeway: float = 0.2) -> Column:
    """|y / x - 1| within the leeway; false where x is 0."""
    return F.coalesce(F.abs(F.try_divide(y, x) - 1) <= leeway, F.lit(False))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings; the largest int when their lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), 2**31 - 1).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def alphanumeric_match(a: Column, b: Column) -> Column:
    """One name contains the other, letters and digits alone compared."""
    x, y = (F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in (a, b))
    return F.contains(x, y) | F.contains(y, x)


def unique_characters(s: Column) -> Column:
    return F.array_join(F.array_distinct(F.split(s, "")), "")


def nth_index(s: Column, char: str, n: int) -> Column:
    """0-based place of the n-th ``char``; -1 when there are fewer, null for null."""
    upto = F.substring_index(s, char, n)
    return F.when(F.size(F.split(s, re.escape(char))) > n, F.length(upto)).when(s.isNotNull(), -1)


def first_whitespace(s: Column) -> Column:
    """0-based place of the first blank; -1 without one."""
    return F.regexp_instr(s, F.lit(r"\s")) - 1


def parse_leading_int(s: Column) -> Column:
    """The integer a string begins with, 0 without one."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0))


def gene_distance(chrom1: Column, end1: Column, chrom2: Column, start2: Column, chrom_length: Column) -> Column:
    """Distance of two genes as a share of their chromosome; 1 across chromosomes."""
    return F.when(chrom1 == chrom2, (start2 - end1) / chrom_length).otherwise(1.0)


def discretize_distance(d: Column) -> Column:
    """Distance rounded to its own power of ten, 10^4 at most."""
    power = F.pow(F.lit(10.0), F.least(F.floor(F.log10(d)), F.lit(4)))
    return F.when(d > 0, (F.floor(d / power + 0.5) * power)).otherwise(d.cast("double"))


def genotype(v: Column) -> Column:
    """hom-ref up to 0.1, hom-alt above 0.9, else het."""
    return F.when(v <= 0.1, "hom_ref").when(v > 0.9, "hom_alt").when(v.isNotNull(), "het")


def genotype_alleles(kind: Column, ref: Column, alt: Column) -> Column:
    return F.when(kind == "hom_ref", F.concat(ref, ref)).when(kind == "hom_alt", F.concat(alt, alt)).when(kind == "het", F.concat(ref, alt))


def deduce_variant(ref: Column, allele1: Column, allele2: Column) -> Column:
    """The allele that isn't the reference; N when both are."""
    return F.when(allele1 != ref, allele1).when(allele2 != ref, allele2).otherwise("N")


def allele_pair_match(a: Column, b: Column) -> Column:
    """How two allele pairs agree: same, flipped, complement, complement_flipped or different."""
    c = complement(b)
    return (F.when(a == b, "same").when(a == F.reverse(b), "flipped").when(a == c, "complement")
            .when(a == F.reverse(c), "complement_flipped").otherwise("different"))


def barcode_role(barcode: Column) -> Column:
    """tumor below sample type 10, else normal; null with fewer than seven fields."""
    parts = F.split(barcode, "-")
    number = F.regexp_extract(F.get(parts, F.lit(3)), "^([0-9]+)", 1).try_cast("int")
    return F.when(F.size(parts) >= 7, F.when(number < 10, "tumor").when(number.isNotNull(), "normal"))


def somatic_location(vaf_normal: Column, cut: float = 0.05) -> Column:
    return F.when(vaf_normal >= cut, "Germline").when(vaf_normal.isNotNull(), "Somatic")


def rescale_score(x: Column, low: Column, high: Column) -> Column:
    """Linear rescale onto browser scores 200..900."""
    return F.floor((x - low) / (high - low + 1) * 700 + 200).cast("int")


def normalize(x: Column, low: Column, high: Column) -> Column:
    return F.try_divide(x - low, high - low)


def power_set(spark: SparkSession, members: list[str]) -> DataFrame:
    """mask and members of each non-empty subset."""
    if len(members) > 20:
        raise ValueError("a power set of more than 20 members")
    parts = [F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(m)) for i, m in enumerate(members)]
    return spark.range(1, 1 << len(members)).select(F.col("id").alias("mask")).withColumn("members", F.array_compact(F.array(*parts)))


def parse_number_lists(text: str) -> list[list[float]]:
    """``({0.5};{0.4,0.6})`` or ``{1,2,3-5}`` as lists of numbers; whole-number ranges are spelt out."""
    out = []
    for body in re.findall(r"\{([^}]*)\}", text):
        numbers: list[float] = []
        for item in filter(None, (x.strip() for x in body.split(","))):
            span = re.fullmatch(r"(\d+)-(\d+)", item)
            numbers += [float(i) for i in range(int(span[1]), int(span[2]) + 1)] if span else [float(item)]
        out.append(numbers)
    return out
