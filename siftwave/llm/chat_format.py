"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share the nodes of those turns. Nodes are emitted once in
depth-first order; each has its place in the stream, the position ids its first code point starts at (the
length of all its ancestors) and the stream intervals of its ancestors, which together with the node itself
are all that its code points may attend to. Assistant texts are under the loss mask.

Turns are marked by control strings. Inside texts and role names each of `\\`, `<`, `[` gets a backslash before it,
so no text can hold a control string, and dropping one backslash of each pair gives the text back.

Order: conversations are range-sorted by their chain of node hashes and numbered; a node belongs to its first
conversation, so (that number, depth) is the depth-first order. Places in the stream are running sums inside
range partitions plus the sums of the partitions before, so no task sees the whole stream. A turn that very many
conversations share is one node; where those look it up, it is copied and they are dealt over the copies.

Defined cases: a null text or role is the empty string; rows with equal conv_id and turn are ordered by role
and text, and all are kept; null turns come first; a null conv_id is a conversation of its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwave.llm.common import scratch_table

#: Fixed control strings: what stands before and after the text of each role.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
#: Most rows of the list of nodes that very many conversations share.
MAX_HOT = 10_000
OTHER = ("<<ROLE ", ">>\n", "\n<</ROLE>>")


def escape(text):
    return F.regexp_replace(text, r"[\\<\[]", r"\\$0")


def unescape(text):
    return F.regexp_replace(text, r"\\([\\<\[])", "$1")


def formatted(role, text):
    """One turn with its marks."""
    out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]), escape(text), F.lit(OTHER[2]))
    for name, (before, after) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(before), escape(text), F.lit(after))).otherwise(out)
    return out


def parsed(segment):
    """role and text of a formatted turn."""
    other = segment.startswith(OTHER[0])
    header = F.regexp_extract(segment, r"(?s)^<<ROLE (.*?)>>\n", 1)
    size = F.char_length(segment)
    cut = lambda a, b: F.substring(segment, a + 1, F.greatest(size - a - b, F.lit(0)))
    role, text = unescape(header), cut(F.char_length(header) + (len(OTHER[0]) + len(OTHER[1])), F.lit(len(OTHER[2])))
    for name, (before, after) in MARKS.items():
        mine = segment.startswith(before) & ~other
        role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, cut(F.lit(len(before)), F.lit(len(after)))).otherwise(text)
    return F.struct(role.alias("role"), unescape(text).alias("text"))


def with_nodes(steps: DataFrame, nodes: DataFrame, total: int, salt_rows: int = 10_000) -> DataFrame:
    """`steps` (conv, depth, node), `total` rows, with the columns of their nodes (node, uses, ...).

    A node of many conversations is copied, and its steps are dealt over the copies. The list of such nodes is
    broadcast; it has at most MAX_HOT rows, as the threshold rises with `total`."""
    copies = F.ceil(F.col("uses") / max(salt_rows, -(-total // MAX_HOT))).cast("int")
    hot = F.broadcast(nodes.select("node", copies.alias("copies")).filter("copies > 1"))
    dealt = steps.join(hot, "node", "left").withColumn("copy", F.pmod(F.xxhash64("conv"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    return dealt.join(nodes.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))), ["node", "copy"]).drop("copy")


def with_interval(acc, start, end):
    """A list of intervals with one more behind it; it grows the last one where they adjoin."""
    last = F.try_element_at(acc, F.lit(-1))
    one = lambda s: F.array(F.struct(s.alias("start"), end.alias("end")))
    joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), one(last["start"]))
    return F.when(F.coalesce(last["end"] == start, F.lit(False)), joined).otherwise(F.concat(acc, one(start)))


def format_chats(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, chats). nodes: node, uses, depth, segment, role, loss, start, len, position, attend (intervals of the ancestors, adjoining ones merged).
    chats: conv_id, conv and path, the nodes from the first turn to the last."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # The parent is empty or 32 hex digits and the role has its length before it, so different turns hash different strings.
    name = lambda acc, t: F.md5(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.char_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]))
    convs = convs.withColumn("path", F.aggregate("turns", F.array().cast("array<string>"), lambda acc, t: F.array_append(acc, name(acc, t))))
    convs = convs.withColumn("lens", F.transform("turns", lambda t: F.char_length(formatted(t["role"], t["text"])).cast("long")))
    chats = scratch_table(convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").withColumn("conv", F.monotonically_increasing_id()), "chats")

    # A conversation owns the nodes that no earlier one has: those from some depth on.
    steps = chats.select("conv", F.posexplode("path").alias("depth", "node"))
    firsts = steps.groupBy("node").agg(F.min(F.struct("conv", "depth")).alias("first"), F.count(F.lit(1)).alias("uses")).select("first.*", "uses")
    owners = firsts.groupBy("conv").agg(F.min("depth").alias("shared"), F.transform(F.array_sort(F.collect_list(F.struct("depth", "uses"))), lambda x: x["uses"]).alias("uses"))
    sized = chats.select("conv", "lens").join(owners, "conv").withColumn("own", F.aggregate(F.slice("lens", F.col("shared") + 1, F.size("lens")), F.lit(0).cast("long"), lambda acc, n: acc + n))
    sized = scratch_table(sized.select("conv", "shared", "uses", "own", F.shiftright("conv", 33).alias("part")), "chat-sizes")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sized.groupBy("part").agg(F.sum("own").alias("total")).select("part", F.coalesce(F.sum("total").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    heads = sized.join(F.broadcast(parts), "part").withColumn("head", F.col("base") + F.coalesce(F.sum("own").over(before(Window.partitionBy("part").orderBy("conv"))), F.lit(0)))
    owned = chats.select("conv", "path", "lens").join(heads.select("conv", "shared", "uses", "head"), "conv").select("conv", "shared", "head", F.col("uses").alias("all"), F.posexplode(F.arrays_zip("path", "lens")).alias("depth", "n")).filter("depth >= shared")
    owned = owned.select("conv", "shared", "head", "depth", F.col("n.path").alias("node"), F.col("n.lens").alias("len"), F.get("all", F.col("depth") - F.col("shared")).alias("uses"))
    placed = scratch_table(owned.withColumn("start", F.col("head") + F.coalesce(F.sum("len").over(before(Window.partitionBy("conv").orderBy("depth"))), F.lit(0))), "placed")

    # Ancestors are the shared nodes of the owner's path and, behind them in the stream without a gap, its own nodes before this one.
    total = chats.agg(F.sum(F.size("path"))).first()[0] or 0
    up = steps.join(sized.select("conv", "shared").filter("shared > 0"), "conv").filter("depth < shared").select("conv", "depth", "node")
    line = with_nodes(up, placed.select("node", "uses", "start", "len"), total).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "start", "len"))).alias("line"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = F.aggregate("line", none, lambda acc, s: with_interval(acc, s["start"], s["start"] + s["len"]))
    line = line.select("conv", spans.alias("spans"), F.aggregate("line", F.lit(0).cast("long"), lambda acc, s: acc + s["len"]).alias("above"))
    full = placed.join(line, "conv", "left").withColumn("spans", F.coalesce("spans", none))
    attend = F.when(F.col("start") > F.col("head"), with_interval(F.col("spans"), F.col("head"), F.col("start"))).otherwise(F.col("spans"))
    full = full.select("conv", "depth", "node", "uses", "start", "len", (F.coalesce("above", F.lit(0)) + F.col("start") - F.col("head")).alias("position"), attend.alias("attend"))
    texts = chats.select("conv", F.posexplode("turns").alias("depth", "t"))
    nodes = full.join(texts, ["conv", "depth"]).select("node", "uses", "depth", formatted(F.col("t.role"), F.col("t.text")).alias("segment"), F.col("t.role").alias("role"), (F.col("t.role") == "assistant").alias("loss"), "start", "len", "position", "attend")
    return scratch_table(nodes, "chat-nodes"), chats.select("conv_id", "conv", "path")


def read_back(nodes: DataFrame, chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, loss) and formatted_chars of each conversation, from the emitted nodes."""
    steps = chats.select("conv_id", "conv", F.posexplode("path").alias("depth", "node"))
    total = chats.agg(F.sum(F.size("path"))).first()[0] or 0
    own = with_nodes(steps, nodes.select("node", "uses", "segment", "loss", "len"), total).withColumn("turn", parsed(F.col("segment")))
    turns = F.array_sort(F.collect_list(F.struct("depth", "turn.role", "turn.text", "loss")))
    return own.groupBy("conv", "conv_id").agg(turns.alias("turns"), F.sum("len").alias("formatted_chars")).drop("conv")


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    back = read_back(*format_chats(rows.unionByName(more)))
    joined = lambda f: F.array_join(F.transform("turns", f), "")
    whole = joined(lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([\\<\[])', '#\1', 'g')) AS n, length(regexp_replace(role, '([\\<\[])', '#\1', 'g')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 ELSE r + 20 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
