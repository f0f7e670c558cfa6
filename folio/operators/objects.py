"""Objects that refer to each other: merging those that are alike, with their references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import removed, written


#: Objects of a document that may name files, in the order in which their files are listed; those of a page go page by page.
FILE_OWNERS = ("Document", "Page", "Annotation", "XObject", "StructureElement")


def associated_files(owners: DataFrame, specs: DataFrame, doc: str, spec: str) -> DataFrame:
    """``doc``, ``spec``, kind, page, relationship, name and content: each file that a document's objects name, once.

    ``owners`` has ``doc``, kind (of FILE_OWNERS), page (null for the document and its structure), position (the object's
    place among those of its kind and page) and files, an array of ``spec``; ``specs`` has ``doc``, ``spec``, relationship, name
    and content, one row for each of both. The first object that names a file is its owner: the document, then each page with its
    annotations and then its other objects, then the structure. A file without a relationship is Unspecified, one
    without a name has the empty name, one without content stays. What an object names without a specification is no file,
    nor is null; objects of other kinds, with null files or none name nothing. Two documents don't share files.

    Names are combined before the shuffle, so a file that very many objects of a document name costs a row for each task.
    An owner is told by its kind and page alone, so what combines is the smallest page of each kind, in a hash table and
    without sorting the objects.
    """
    kinds = range(1, len(FILE_OWNERS) + 1)
    kind = F.array_position(F.array(*[F.lit(k) for k in FILE_OWNERS]), F.col("kind")).cast("int")
    named = owners.where(kind > 0).select(doc, "page", kind.alias("_kind"), F.explode("files").alias(spec)).where(F.col(spec).isNotNull())
    without = F.bit_or(F.when(F.col("page").isNull(), F.call_function("shiftleft", F.lit(1), F.col("_kind"))).otherwise(F.lit(0))).alias("_without")
    first = named.groupBy(doc, spec).agg(without, *[F.min(F.when(F.col("_kind") == k, F.col("page"))).alias(f"_p{k}") for k in kinds])
    # Of a part of the document those without a page come first, then the smallest page; of the same page the first kind.
    owner = lambda k, page: F.struct(F.lit(FILE_OWNERS[k - 1]).alias("kind"), page.alias("page"))
    steps = []
    for part in (kinds[:1], kinds[1:-1], kinds[-1:]):
        pages = [F.col(f"_p{k}") for k in part]
        least = F.least(*pages) if len(pages) > 1 else pages[0]
        steps += [(F.col("_without").bitwiseAND(1 << k) != 0, owner(k, F.lit(None).cast(owners.schema["page"].dataType))) for k in part]
        steps += [(F.col(f"_p{k}") == least, owner(k, F.col(f"_p{k}"))) for k in part]
    told_by = F.coalesce(*[F.when(*step) for step in steps])
    first = first.select(doc, spec, told_by.alias("_first"))
    found = first.join(specs.select(doc, spec, "relationship", "name", "content"), [doc, spec])
    told = [F.coalesce("relationship", F.lit("Unspecified")).alias("relationship"), F.coalesce("name", F.lit("")).alias("name")]
    return found.select(doc, spec, "_first.kind", "_first.page", *told, "content")


def merge_identical(objects: DataFrame, references: DataFrame, most_passes: int | None = None) -> DataFrame:
    """id, representative and merged_in: the smallest id of the objects that an object equals, and the pass that found it.

    ``objects`` (id, content, mergeable) and ``references`` (id, place, target; places are distinct in an object). Objects are
    equal if they have the same content and, in the same places, targets with the same representative. Merging
    targets can make those that refer to them equal, so passes repeat until nothing merges, or ``most_passes`` are done.
    Objects that aren't mergeable represent themselves; a target that is no object counts as itself, and objects that equal
    each other only through a cycle stay apart, as no pass begins there. Null content is a content of its own.

    A pass joins references with their targets' representatives, combines an object's references into sums of the halves of two
    64-bit hashes before the shuffle, however many it has, and groups objects by the digest of their content and those
    sums. References are written once, for all passes.
    """
    references = written(references.select("id", "place", "target"), "references")
    held = written(objects.select("id", F.sha2(F.coalesce(F.concat(F.lit("c"), F.col("content").cast("string")), F.lit("n")).cast("binary"), 256).alias("_content"), F.col("mergeable").alias("_may")), "objects")
    now = written(held.select("id", F.col("id").alias("representative"), F.lit(0).alias("merged_in")), "representatives")
    classes, passes = now.count(), 0
    while most_passes is None or passes < most_passes:
        passes += 1
        known = now.select(F.col("id").alias("target"), F.col("representative").alias("_target"))
        seen = references.join(known, "target", "left").select("id", "place", F.coalesce("_target", "target").alias("_target"))
        hashed = seen.select("id", *[F.xxhash64(F.lit(seed), "place", "_target").alias(f"_h{seed}") for seed in (1, 2)])
        halves = [h for seed in (1, 2) for h in (F.col(f"_h{seed}").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(f"_h{seed}", 32))]
        sums = hashed.groupBy("id").agg(*[F.sum(h).alias(f"_s{i}") for i, h in enumerate(halves)], F.count(F.lit(1)).alias("_n"))
        digest = F.xxhash64("_content", "_s0", "_s1", "_s2", "_s3", "_n"), F.xxhash64(F.lit(7), "_content", "_s3", "_s2", "_s1", "_s0", "_n")
        signed = held.join(sums, "id", "left").select("id", "_may", digest[0].alias("_d1"), digest[1].alias("_d2"))
        least = signed.where("_may").groupBy("_d1", "_d2").agg(F.min("id").alias("_least"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
        found = signed.join(least, ["_d1", "_d2"], "left").select("id", F.when(F.col("_may"), F.col("_least")).alias("_least"))
        merged = now.join(found, "id").select("id", F.coalesce("_least", "representative").alias("representative"), F.when(F.col("_least") != F.col("representative"), passes).otherwise(F.col("merged_in")).alias("merged_in"))
        then = written(merged, "representatives")
        removed(now)
        now = then
        left = now.select("representative").distinct().count()
        if left == classes:
            break
        classes = left
    removed(held, references)
    return now
