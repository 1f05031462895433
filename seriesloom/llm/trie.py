"""Prefix trie of rebuilt conversations, from whole sequences that are collapsed first.

Every prefix has a key: the sum of hashes of its turns with their places, so keys are running sums and a conversation of
any length can be cut among tasks. Identical sequences become one weighted sequence with the list of those that end
there; a sequence is a leaf when no other sequence has it as a proper prefix; the prefixes of the weighted sequences,
one representative each, are added up to nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seriesloom.functions.lanes import lay_out, small
from seriesloom.lineage import pin
from seriesloom.llm.common import attach
from seriesloom.llm.streams import sha256_of

KEY = ["_none", "_id"]                # a conversation: whether it has no id, and the id
NODE, ABOVE = ["_k1", "_k2"], ["_p1", "_p2"]
FAMILY, LONGEST_HEAD = 100, 5         # conversations that share the first turns of one, and how many at most
ENDS = 1 << 16                        # longer lists of ends are cut among tasks
SUMS = ["_s0", "_s1", "_s2", "_s3"]


def head_length(conv_id: Column) -> Column:
    """How many first turns a conversation takes over: CRC-32 of the decimal id modulo 6, none without an id."""
    return F.coalesce(F.crc32(conv_id.cast("string").cast("binary")) % (LONGEST_HEAD + 1), F.lit(0))


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    return conversations.select(F.col("conv_id").isNull().alias("_none"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("_id"),
                                "turn", digest.alias("_turn"), F.length(text).cast("long").alias("_chars"))


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, int]:
    """(_none, _id, _part, _at, _turn, _chars) of all rebuilt turns and one root row each; a bound of a conversation's rows."""
    lanes = lay_out(_turns(conversations), KEY, ["turn", "_turn"])
    own = lanes.done(lanes.df)
    h = F.when(F.col("_none"), 0).otherwise(head_length(F.col("_id")))
    tail = own.where(F.col("step") >= h).select(*KEY, F.lit(1).alias("_part"), F.col("step").alias("_at"), "_turn", "_chars")
    convs = own.where("step = 0").select(*KEY)
    root = convs.select(*KEY, F.lit(-1).alias("_part"), F.lit(0).cast("long").alias("_at"), F.lit(b"").alias("_turn"), F.lit(0).cast("long").alias("_chars"))
    first = (own.where((F.col("_id") % FAMILY == 0) & ~F.col("_none") & (F.col("step") < LONGEST_HEAD))
             .select(F.col("_id").alias("_base"), F.col("step").alias("_at"), "_turn", "_chars"))
    takers = convs.where(~F.col("_none")).select(*KEY, (F.col("_id") - F.col("_id") % FAMILY).alias("_base"), h.alias("_h"))
    head = takers.join(first, "_base").where("_at < _h").select(*KEY, F.lit(0).alias("_part"), "_at", "_turn", "_chars")
    return tail.unionByName(root).unionByName(head), lanes.longest + LONGEST_HEAD + 1


def _key(sums: list[Column]) -> tuple[Column, Column]:
    """Two longs of four sums of 32-bit hashes."""
    return F.shiftleft(sums[0], 32).bitwiseXOR(sums[1]), F.shiftleft(sums[2], 32).bitwiseXOR(sums[3])


def _prefixes(conversations: DataFrame) -> tuple[DataFrame, int]:
    """(_none, _id, depth, _k1, _k2, _p1, _p2, _chars): every conversation's prefixes with their key and the one above."""
    rows, bound = _rebuilt(conversations)
    lanes = lay_out(rows, KEY, ["_part", "_at"], bound=bound)
    parts = []
    for seed in (0, 1):
        x = F.when(F.col("_part") >= 0, F.xxhash64("_turn", "step", F.lit(seed))).otherwise(0)
        parts += [F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))]
    summed = lanes.done(lanes.running(lanes.df, **{s: ("sum", p) for s, p in zip(SUMS, parts)}))
    here, above = _key([F.col(s) for s in SUMS]), _key([F.col(s) - p for s, p in zip(SUMS, parts)])
    return pin(summed.select(*KEY, F.col("step").alias("depth"), *(c.alias(n) for c, n in zip((*here, *above), NODE + ABOVE)), "_chars")), bound


def _ends(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """(_k1, _k2, ends_sha256) of every sequence; lists over ``ENDS`` are sorted over many tasks and hashed as a stream."""
    ids = F.when(~F.col("_none"), F.col("_id"))
    joined = F.array_join(F.sort_array(F.collect_list(ids)).cast("array<string>"), ",")
    hot = sequences.where(F.col("_weight") > ENDS).select(*NODE)
    n_hot, n_rows = sequences.where(F.col("_weight") > ENDS).agg(F.count("*"), F.sum("_weight")).first()
    if not n_hot:
        return members.groupBy(*NODE).agg(F.sha2(joined.cast("binary"), 256).alias("ends_sha256"))
    hot = small(hot, n_hot)
    few = members.join(hot, NODE, "left_anti").groupBy(*NODE).agg(F.sha2(joined.cast("binary"), 256).alias("ends_sha256"))
    many = pin(members.join(hot, NODE, "left_semi").where(~F.col("_none")).repartitionByRange(-(-n_rows // ENDS) + 1, *NODE, "_id")
               .withColumn("_piece", F.spark_partition_id()))
    lists = many.groupBy(*NODE, "_piece").agg(joined.alias("_list"))
    return few.unionByName(sha256_of(lists, NODE, "_piece", "_list", ",", "ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` needs conv_id (long), turn, role and text; other columns, whatever their names, are not read. Turns
    are taken by turn, null first, rows of one turn by a hash of role and text, repeated rows each for themselves; null
    roles and texts are empty. Conversation c begins with the first h turns of conversation c - c % 100 and goes on with
    its own after its first h. Rows without a conv_id are one conversation that takes nothing over; it counts as a
    member, ranks after all ids and is left out of lists of ends. Equal sequences are told by 128-bit hashes. An empty
    table has no conversation and gives no rows. Long conversations are cut into lanes, common nodes are added up
    before they are shuffled, and long lists of ends are hashed as streams.
    """
    rows, bound = _prefixes(conversations)
    members = rows.groupBy(*KEY).agg(F.max(F.struct("depth", *NODE)).alias("_end")).select(*KEY, "_end.*")
    sequences = pin(members.groupBy(*NODE).agg(F.min(F.struct(*KEY)).alias("_rep"), F.count("*").alias("_weight")))
    inner = rows.where("depth > 0").select(*(F.col(a).alias(k) for a, k in zip(ABOVE, NODE))).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select(*NODE, F.lit(1).cast("long").alias("_leaf"))
    weighted = sequences.join(leaves, NODE, "left").select("_rep.*", "_weight", F.coalesce("_leaf", F.lit(0)).alias("_leaf"))
    paths = rows.join(weighted, KEY)
    nodes = pin(paths.groupBy(*NODE).agg(F.min(F.struct(*KEY)).alias("_rep"), F.sum("_weight").alias("n_convs"), F.sum("_leaf").alias("n_leaves"),
                                         *(F.max(c).alias(c) for c in ("depth", *ABOVE, "_chars")))
                .select("_rep.*", *NODE, *ABOVE, "depth", "n_convs", "n_leaves", ((F.col("n_convs") - 1) * F.col("_chars")).alias("_own")))
    n_nodes = nodes.count()

    # A node's own saving is counted on the path of its smallest member; sums from a path's end upwards add its subtree.
    owned = paths.select(*KEY, "depth", *NODE).join(nodes.select(*KEY, "depth", "_own"), [*KEY, "depth"], "left").withColumn("_up", -F.col("depth"))
    upwards = lay_out(owned, KEY, ["_up"], bound=bound)
    saved = (upwards.done(upwards.running(upwards.df, _below=("sum", F.coalesce("_own", F.lit(0)))))
             .groupBy(*NODE).agg(F.sum("_below").alias("saved_tokens")))
    children = (nodes.where("depth > 0").groupBy(*(F.col(a).alias(k) for a, k in zip(ABOVE, NODE)))
                .agg(F.count("*").alias("n_children")))
    named = F.when(~F.col("_none"), F.col("_id"))
    full = pin(nodes.join(saved, NODE).join(children, NODE, "left").join(_ends(members, sequences), NODE, "left")
               .select(*NODE, *ABOVE, named.alias("conv_id"), "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                       "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")))
    parents = full.where("n_children > 0").select(*(F.col(k).alias(a) for k, a in zip(NODE, ABOVE)), F.col("conv_id").alias("parent_conv_id"),
                                                  F.col("n_children").alias("_n"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = attach(full.where("depth > 0"), parents, ABOVE, "_n", n_nodes).select(*out)
    return below.unionByName(full.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out))
