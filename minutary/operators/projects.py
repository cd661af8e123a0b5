"""Project names: alias catalogue, look-ups, and ordered catalogue growth."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..sources.scratch import final, settle
from . import models, ordered


def catalogue(projects: DataFrame, aliases: DataFrame) -> DataFrame:
    """project_id, canonical_name, aliases (sorted, joined by |) of every project, also of those without aliases."""
    found = aliases.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set("alias_name")), "|").alias("aliases"))
    return projects.join(found, "project_id", "left").select("project_id", "canonical_name", F.coalesce("aliases", F.lit("")).alias("aliases"))


def alias_owners(names: DataFrame) -> DataFrame:
    """From rows (ord, canonical, alias): the first canonical name of each alias key, and how many others claim it."""
    keyed = names.withColumn("alias_key", T.loose_key(F.col("alias"))).filter("alias_key <> ''")
    return keyed.groupBy("alias_key").agg(F.min_by("canonical", F.struct("ord", "canonical")).alias("owner"), F.min_by("alias", F.struct("ord", "canonical")).alias("alias_name"), (F.count_distinct("canonical") - 1).alias("n_conflicts"))


def look_up(rows: DataFrame, owners: DataFrame, name: str = "source_name") -> DataFrame:
    """Adds canonical and resolution (none, existing, unknown) by alias key; the key side is hashed, so a frequent name is no skew for it."""
    keyed = rows.withColumn("alias_key", T.loose_key(F.col(name)))
    out = keyed.join(owners.select("alias_key", "owner"), "alias_key", "left")
    return out.select(*rows.columns, F.col("owner").alias("canonical"), F.when(T.strip(F.col(name)) == "", F.lit("none")).when(F.col("owner").isNotNull(), F.lit("existing")).otherwise(F.lit("unknown")).alias("resolution"))


#: Open links (an order and keys) that one task may settle.
FINISH = 50_000
_LINK = "ord long, key string, new_key string, asked string, made string, owner string, name string"
_KNOWN = "key string, project_id string, since long, name string, created boolean"


def _link_in_order(batches):
    """Links in order to names that become known: (key, project, since, name of a project that is made, whether it is)."""
    known: dict[str, str] = {}
    made: set[str] = set()
    for b in batches:
        out: list[tuple] = []
        for ord_, key, new_key, asked, project, owner, name in zip(*(b.column(f.split(" ")[0]).to_pylist() for f in _LINK.split(", "))):
            if key in known:
                continue
            if new_key is None:
                if owner is None and asked not in made:
                    continue  # there is no such project yet
                known[key] = owner or asked
            else:
                there = owner or known.get(new_key)
                known[key] = there or project
                if there is None:
                    made.add(project)
                    out.append((new_key, project, ord_, name, True))
                    known[new_key] = project
            if key != new_key or out and out[-1][2] != ord_:
                out.append((key, known[key], ord_, None, False))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()))], [f.split(" ")[0] for f in _KNOWN.split(", ")])


def learn(links: DataFrame, bin_: list[str]) -> DataFrame:
    """Names that links make known, in order: key, project_id, since, name (of a project that is made), created.

    links(ord, key, new_key, asked, made, owner, name): a row links its name (key, unknown at first) either with a project that is
    ``asked`` for (owner: that it is there at first) or with the project that has the name new_key (owner: the project that has it at
    first; otherwise one that was made before, or the project ``made``, whose own name new_key becomes known as well). A row whose
    name is known by its turn links nothing. Of each name all rows after the first sure one are left out at once; the rest is settled
    in rounds of rows that come first for all names and projects they speak of, and in one task once few are open.
    """
    sure = F.col("owner").isNotNull() | F.col("new_key").isNotNull()
    least = links.filter(sure).groupBy(F.col("key").alias("_k")).agg(F.min("ord").alias("_o"))
    open_ = settle(links.join(least, F.col("key") == F.col("_k"), "left").filter("_o is null or ord <= _o").drop("_k", "_o"), "links", bin_)
    known: DataFrame | None = None
    while open_.limit(FINISH + 1).count() > FINISH:
        said = F.array_compact(F.array(F.concat(F.lit("n"), "key"), F.when(F.col("owner").isNull(), F.concat(F.lit("n"), "new_key")), F.when(F.col("owner").isNull(), F.concat(F.lit("p"), F.coalesce("asked", "made")))))
        each = open_.select("ord", F.explode(F.array_distinct(said)).alias("m"))
        first = each.groupBy("m").agg(F.min("ord").alias("f"))
        held = each.join(first, "m").groupBy("ord").agg(F.bool_and(F.col("ord") == F.col("f")).alias("_ready"))
        marked = settle(open_.join(held, "ord"), "links", bin_)
        # ready rows speak of different names and projects, so that each is settled alone
        new = settle(marked.filter("_ready").drop("_ready").mapInArrow(_each_alone, _KNOWN), "known", bin_)
        known = new if known is None else known.unionByName(new)
        names = new.select("key", F.col("project_id").alias("_p"))
        rest = marked.filter("not _ready").drop("_ready").join(names.select("key"), "key", "left_anti")
        rest = rest.join(names.select(F.col("key").alias("new_key"), "_p"), "new_key", "left").withColumn("owner", F.coalesce("owner", "_p")).drop("_p")
        there = new.filter("created").select(F.col("project_id").alias("asked"), F.col("project_id").alias("_q"))
        rest = rest.join(there, "asked", "left").withColumn("owner", F.coalesce("owner", "_q")).drop("_q")
        open_ = settle(rest.select(*(f.split(" ")[0] for f in _LINK.split(", "))), "links", bin_)
    last = open_.coalesce(1).sortWithinPartitions("ord").mapInArrow(_link_in_order, _KNOWN)
    return settle(last if known is None else known.unionByName(last), "known", bin_)


def _each_alone(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield from _link_in_order([b.slice(i, 1)])


def resolve(rows: DataFrame, projects: DataFrame, aliases: DataFrame, answers: DataFrame) -> DataFrame:
    """Project of each row(record_id, ord, source_name): blank names have none, known names their owner, the rest what a model answered.

    answers(record_id, resolution, project_id, canonical_name, confidence). An existing project must be there at the row's turn; a new
    one needs a name, and reuses the project that has it. The row makes its name known, and a project that it makes by its own name as
    well: later rows of either name follow it with confidence 1, and later answers reuse it (``learn``). Names known from the start need
    no answer. Faults: no_answer, unknown_project, canonical_name_required.
    """
    bin_: list[str] = []
    keys = projects.select("project_id", T.loose_key(F.col("canonical_name")).alias("key")).union(aliases.select("project_id", T.loose_key(F.col("alias_name")).alias("key")))
    known = keys.filter("key <> ''").groupBy("key").agg(F.min("project_id").alias("_owner"))
    names = projects.groupBy("project_id").agg(F.min("canonical_name").alias("_name"))
    said = answers.select("record_id", models.resolution(F.col("resolution"), F.col("project_id"), F.col("canonical_name")).alias("_said"), F.col("project_id").alias("_asked"), T.nullable(F.col("canonical_name")).alias("_new"), F.coalesce("confidence", F.lit(1.0)).alias("_sure"))
    rows = rows.select("record_id", F.col("ord").cast("long").alias("ord"), "source_name", T.loose_key(F.col("source_name")).alias("_key")).join(known.withColumnRenamed("key", "_key"), "_key", "left")
    rows = rows.join(said, "record_id", "left").join(names.select(F.col("project_id").alias("_asked"), F.lit(True).alias("_there")), "_asked", "left")
    rows = rows.withColumn("_new_key", T.loose_key(F.col("_new"))).join(known.select(F.col("key").alias("_new_key"), F.col("_owner").alias("_same")), "_new_key", "left")
    blank = T.strip(F.col("source_name")) == ""
    rows = settle(rows.withColumn("_miss", ~blank & F.col("_owner").isNull() & (F.col("_key") != "")).withColumn("_blank", blank), "asked", bin_)
    named = (F.col("_said") == "new") & F.col("_new").isNotNull()
    links = rows.filter(F.col("_miss") & ((F.col("_said") == "existing") & F.col("_asked").isNotNull() | named)).select(
        "ord", F.col("_key").alias("key"), F.when(named, F.col("_new_key")).alias("new_key"), F.when(~named, F.col("_asked")).alias("asked"), F.when(named, T.digest_id("P", 10, F.col("_new_key"))).alias("made"),
        F.when(named, F.col("_same")).otherwise(F.when(F.col("_there"), F.col("_asked"))).alias("owner"), F.when(named, F.col("_new")).alias("name"),
    )
    learnt = learn(links, bin_)
    now = learnt.select(F.col("key").alias("_key"), F.col("project_id").alias("_learnt"), F.col("since").alias("_since"))
    rows = rows.join(now, "_key", "left")
    late, own = F.coalesce(F.col("_miss") & (F.col("_since") < F.col("ord")), F.lit(False)), F.coalesce(F.col("_miss") & (F.col("_since") == F.col("ord")), F.lit(False))
    fault = F.when(F.col("_said").isNull(), F.lit("no_answer")).when((F.col("_said") == "new") & F.col("_new").isNull(), F.lit("canonical_name_required")).when((F.col("_said") == "existing") & ~own, F.lit("unknown_project"))
    rows = rows.withColumns({
        "project_id": F.when(~F.col("_blank"), F.coalesce("_owner", F.when(late | own, F.col("_learnt")))),
        "fault": F.when(F.col("_miss") & ~late, fault),
    })
    rows = rows.withColumns({
        "resolution": F.when(late | (F.col("_owner").isNotNull() & ~F.col("_blank")), F.lit("existing")).when(~F.col("_miss"), F.lit("none")).when(F.col("fault").isNull(), F.col("_said")),
        "confidence": F.when(own, F.col("_sure")).when(late | ~F.col("_miss") | F.col("fault").isNull(), F.lit(1.0)),
    })
    called = names.unionByName(learnt.filter("created").select("project_id", F.col("name").alias("_name")))
    rows = rows.join(called, "project_id", "left")
    return final(rows.select("record_id", "ord", F.nullif(T.strip(F.col("source_name")), F.lit("")).alias("source_name"), "resolution", "project_id", F.when(F.col("project_id").isNotNull(), F.col("_name")).alias("canonical_name"), "confidence", "fault"), "resolved", bin_)


def grow(projects: DataFrame, aliases: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New projects, new aliases and conflicts from wanted (ord, canonical, alias).

    A canonical name whose key is known reuses its project; otherwise its first occurrence makes one, with a digest as id.
    An alias that belongs to another project is a conflict row and isn't added.
    """
    known = projects.select("project_id", T.loose_key(F.col("canonical_name")).alias("key")).union(aliases.select("project_id", T.loose_key(F.col("alias_name")).alias("key"))).groupBy("key").agg(F.min("project_id").alias("known_id"))
    keyed = wanted.withColumns({"key": T.loose_key(F.col("canonical")), "alias_key": T.loose_key(F.col("alias"))})
    heads = keyed.groupBy("key").agg(F.min_by("canonical", "ord").alias("canonical_name")).join(known, "key", "left")
    heads = heads.select("key", "canonical_name", "known_id", F.coalesce("known_id", T.digest_id("P", 10, F.col("key"))).alias("project_id"))
    new_projects = heads.filter("known_id is null").select("project_id", "canonical_name")
    claims = keyed.join(heads.select("key", "project_id"), "key").filter("alias_key <> ''")
    owner = aliases.select(T.loose_key(F.col("alias_name")).alias("alias_key"), F.col("project_id").alias("owner_id")).groupBy("alias_key").agg(F.min("owner_id").alias("owner_id"))
    first = claims.groupBy("alias_key").agg(F.min_by(F.struct("project_id", "alias", "ord"), F.struct("ord", "project_id")).alias("f")).join(owner, "alias_key", "left")
    new_aliases = first.filter("owner_id is null").select("alias_key", F.col("f.alias").alias("alias_name"), F.col("f.project_id").alias("project_id"))
    settled = first.select("alias_key", F.coalesce("owner_id", "f.project_id").alias("owner_id"))
    conflicts = claims.join(settled, "alias_key").filter("project_id <> owner_id").select("ord", "canonical", "alias", "project_id", "owner_id")
    return new_projects, new_aliases, conflicts


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The row of each key with the greatest ``at``; map-side, without sorting groups."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(at, *[c for c in rows.columns if c not in (key, at)])).alias("_r")).select("_r.*")


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows that an insert-or-ignore would add: keys not in table, each key's first row."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")
    return first.join(table.select(key), key, "left_anti")


def clusters(rows: DataFrame, group: str, order: list[str], similar: str, least: float, block: int = ordered.BLOCK) -> DataFrame:
    """Gaps and islands: adds cluster, which counts up wherever ``similar`` to the row before falls under ``least`` or is null.

    A group of more than ``block`` rows is summed in blocks, and the sums of the blocks before are added.
    """
    return ordered.running(rows, [group], order, F.when(F.col(similar) >= least, 0).otherwise(1), "cluster", block)
