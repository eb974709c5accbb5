"""Tables that Spark derives from the given ones.

The given tables hold markup and prose but no program code, so code is
rendered from ``part`` (one file per part) and symbol nodes are built from
``customer``, ``supplier`` and ``orders``. Each derivation is one SQL expression that
both engines understand, so an oracle can restate the result from the columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows that texts are rendered from, spread evenly before that, into as many parts as a shuffle has.

    The number is stated, as Spark would join parts that are small until there
    are about as many as cores, and one part more than cores doubles the time.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def render(template: str) -> str:
    """``text <<expr>> text`` to a concatenation valid in Spark SQL and DuckDB."""
    parts = []
    for piece in re.split(r"(<<.*?>>|\n)", template):
        if piece == "\n":
            parts.append("chr(10)")
        elif piece.startswith("<<"):
            parts.append(f"CAST({piece[2:-2]} AS STRING)")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)



SWIFT = """import Foundation
import Kit<<p_size % 7>>
// class Hidden<<p_partkey>>: Nothing { }
/* block func commented<<p_partkey>>() {
*/
<<CASE WHEN p_size % 5 = 0 THEN '@MainActor' ELSE '' END>>
public final class Part<<p_partkey>>: Base<<p_size % 9>>, Proto<<p_partkey % 11>> {
    private let title<<p_partkey>> = "<<p_name>>"
    @objc var count<<p_partkey>>: Int = <<p_size>>
    static func load<<p_partkey>>(with id: Int, _ flag: [String: Int]) -> String {
        let url = "<<p_type>>"
        if count<<p_partkey>> > 3 {
            print("load <<p_partkey>>", url)
        } else if let other = url {
            debugPrint(
                "x)",
                url)
        }
        for (a, b) in pairs {
            helper<<p_size % 5>>(a)
        }
        return url
    }
    override func draw<<p_partkey>>(rect: Rect<<p_partkey % 3>> = zero) { helper<<p_size % 5>>(x: 1) }
    enum Mode<<p_partkey>>: String {
        case on<<p_partkey>>, off(level: Int, Double)
    }
    func nested<<p_partkey>>() async throws -> some View {
        func inner<<p_partkey>>() { }
        Text("hi <<p_name>>")
    }
}
extension Part<<p_partkey % 50>>: Printable<<p_partkey % 4>> where T: Any {
    func extra<<p_partkey>>(cb: @escaping (Int) -> Void) { }
}
protocol Proto<<p_partkey % 11>> {
    func draw<<p_partkey>>(rect: Int)
}
actor Store<<p_partkey>> {
    nonisolated func peek<<p_partkey>>() { }
    func poke<<p_partkey>>(_ x: inout Int, y: Mode<<p_partkey>>) { }
}
typealias Pair<<p_partkey>> = Proto<<p_partkey % 11>> & Proto<<(p_partkey + 1) % 11>>
func free<<p_partkey>>() -> Self { }
let top<<p_partkey>> = "<<p_brand>>"
"""
SWIFT_PATH = render("Sources/<<p_type>>/Part<<p_partkey>>.swift")


def swift_files(spark: SparkSession, sf: str) -> DataFrame:
    """(project, file_id, rel_path, text): one rendered source file per part."""
    return dealt(table(spark, sf, "part"), "p_partkey").select(
        F.expr("p_brand").alias("project"), F.expr("p_partkey").alias("file_id"),
        F.expr(SWIFT_PATH).alias("rel_path"), F.expr(render(SWIFT)).alias("text"))


# A second kind of file: every reason for a literal to stay, regions, case and guard blocks. Lines are numbered in comments where oracles need them.
SWIFT_2 = """import UIKit
let root<<p_partkey>> = "global text"
@main struct Entry<<p_partkey>>: App {
    static func main() {
        start("entry <<p_name>>")
    }
}
class Screen<<p_size>> {
    @available(*, message: "attr text")
    func show<<p_partkey>>() {
        cell(withIdentifier: "cell id")
        log(f(g(1)), "debug text")
        use(NSLocalizedString(
            "localized key", comment: c))
        alert.title(
            "ui text"
        )
        plain("kept <<p_name>>", "x")
        plain("kept <<p_type>>")
        plain("value <<chr(92)>>(x)")
        set(#imageLiteral(resourceName: "image"))
        let k: LocalizedStringKey = "resource"
    }
    #if DEBUG
    func hidden<<p_partkey>>() {
    }
    #endif
    /* func commented() {
    */
    func after<<p_partkey>>() {
        switch x {
        case 1:
            print("a")
        default:
            VStack { label("in a container") }
        }
        guard ok else {
            assert(false)
        }
    }
    @objc
    func marked<<p_partkey>>() {
    }
    static func fixed() {
    }
    func result() -> Int {
    }
}
extension Screen<<p_size>> {
    func inExtension() {
    }
}
"""


def second_files(spark: SparkSession, sf: str) -> DataFrame:
    """(project, file_id, text): the second template, with every seventh text null, every seventh empty and every seventh unbalanced."""
    k, whole = F.col("p_partkey"), F.expr(render(SWIFT_2))
    text = (F.when(k % 7 == 1, F.lit(None).cast("string")).when(k % 7 == 2, "").when(k % 7 == 3, F.lit("} ) { func x( {\n\"open")).otherwise(whole))
    return dealt(table(spark, sf, "part"), "p_partkey").select(F.col("p_brand").alias("project"), k.alias("file_id"), text.alias("text"))


# Names in four casings, by key.
IDENT = ("CASE p_partkey % 4 WHEN 0 THEN split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)"
         " WHEN 1 THEN upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)"
         " WHEN 2 THEN replace(p_name, ' ', '_') ELSE upper(replace(p_name, ' ', '-')) || '_' END")


def ident_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.expr(IDENT).alias("name"))


NODE_SQL = {
    "customer": """c_custkey * 10 + 1 AS node_id, CAST(NULL AS BIGINT) AS parent_id, 'Cust' || CAST(c_custkey AS STRING) AS name,
        CASE c_custkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'struct' WHEN 2 THEN 'enum' WHEN 3 THEN 'protocol' ELSE 'actor' END AS kind,
        CASE c_custkey % 3 WHEN 0 THEN 'public' ELSE 'internal' END AS access,
        CASE c_custkey % 6 WHEN 0 THEN list_value('objcMembers') WHEN 1 THEN list_value('main') WHEN 2 THEN list_value('Model')
             WHEN 3 THEN list_value('globalActor', 'final') WHEN 4 THEN list_value('frozen') ELSE list_value('State') END AS attributes,
        CASE WHEN c_custkey % 4 = 0 THEN list_value('Alias' || CAST(c_nationkey AS STRING), 'Cust' || CAST(c_custkey % 40 + 3 AS STRING))
             WHEN c_custkey % 4 = 1 THEN list_value('Codable') ELSE list_value('Cust' || CAST(c_custkey % 30 AS STRING)) END AS adopted,
        list_value('_', 'c' || CAST(c_nationkey AS STRING)) AS params,
        'F' || CAST(c_custkey % 100 AS STRING) || '.swift:' || CAST(c_custkey AS STRING) AS location, 0 AS is_exception""",
    "supplier": """s_suppkey * 10 + 2 AS node_id, CAST(NULL AS BIGINT) AS parent_id, 'Cust' || CAST(s_suppkey % 60 AS STRING) AS name,
        'extension' AS kind, 'internal' AS access, list_value('ext') AS attributes,
        list_value('Ext' || CAST(s_nationkey AS STRING), 'Encodable') AS adopted, list_value('_') AS params,
        'E' || CAST(s_suppkey AS STRING) || '.swift:1' AS location, 0 AS is_exception""",
    "orders": """o_orderkey * 10 + 3 AS node_id, o_custkey * 10 + 1 AS parent_id,
        CASE o_orderkey % 10 WHEN 0 THEN 'body' WHEN 1 THEN 'main' WHEN 2 THEN 'shared' WHEN 3 THEN 'init'
             WHEN 4 THEN chr(96) || 'keep' || CAST(o_orderkey % 20 AS STRING) || chr(96)
             WHEN 5 THEN 'keep' || CAST(o_orderkey % 40 AS STRING) ELSE 'm' || CAST(o_orderkey % 200 AS STRING) END AS name,
        CASE o_orderkey % 3 WHEN 0 THEN 'variable' WHEN 1 THEN 'function' ELSE 'case' END AS kind, 'private' AS access,
        CASE o_orderkey % 8 WHEN 0 THEN list_value('objc') WHEN 1 THEN list_value('IBOutlet') WHEN 2 THEN list_value('override') ELSE list_value('lazy') END AS attributes,
        list_value('none') AS adopted, list_value('_', 'p' || CAST(o_orderkey % 50 AS STRING)) AS params,
        'O' || CAST(o_orderkey AS STRING) || '.swift:' || CAST(o_custkey AS STRING) AS location,
        CASE WHEN o_orderkey % 130 = 5 OR o_orderkey % 130 = 17 THEN 1 ELSE 0 END AS is_exception""",
}
NODES_CTE = "nodes AS (" + " UNION ALL ".join(f"SELECT {cols} FROM {name}" for name, cols in NODE_SQL.items()) + ")"


def _columns(sql: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(sql):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(sql[start:i])
            start = i + 1
    return [c.strip() for c in [*out, sql[start:]]]


def node_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Types from customers, extensions from suppliers, members from orders."""
    out = None
    for name, sql in NODE_SQL.items():
        part = table(spark, sf, name).selectExpr(*_columns(sql.replace("list_value(", "array(")))
        out = part if out is None else out.unionByName(part)
    return out


EDGES_SQL = """edges AS (
  SELECT 'R' || CAST(n_regionkey AS STRING) AS parent, 'N' || CAST(n_nationkey AS STRING) AS child FROM nation
  UNION ALL SELECT 'N' || CAST(c_nationkey AS STRING), 'C' || CAST(c_custkey AS STRING) FROM customer
  UNION ALL SELECT 'C' || CAST(o_custkey AS STRING), 'O' || CAST(o_orderkey AS STRING) FROM orders)"""


def key_edges(spark: SparkSession, sf: str) -> DataFrame:
    def link(name: str, up: str, parent: str, down: str, child: str) -> DataFrame:
        return table(spark, sf, name).select(F.concat(F.lit(up), F.col(parent).cast("string")).alias("parent"),
                                             F.concat(F.lit(down), F.col(child).cast("string")).alias("child"))
    return (link("nation", "R", "n_regionkey", "N", "n_nationkey")
            .unionByName(link("customer", "N", "c_nationkey", "C", "c_custkey"))
            .unionByName(link("orders", "C", "o_custkey", "O", "o_orderkey")))


LOG_LINE = """CASE event_type WHEN 'view' THEN 'mapping' WHEN 'click' THEN 'id-obf' WHEN 'signup' THEN 'cff' WHEN 'purchase' THEN 'opaq' ELSE 'deadcode' END
 || CASE WHEN event_id % 7 = 0 THEN ' working on it' ELSE ': ' || CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'done' ELSE 'skip' END END"""


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(run_id, ts, line): one log line per event, users as runs."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), "ts", F.expr(LOG_LINE.replace("\n", " ")).alias("line"), "event_id")
