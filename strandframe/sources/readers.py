"""Text formats to DataFrames."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _records(spark: SparkSession, path) -> DataFrame:
    """One row per record that starts with > at a line's start, split by the reader itself: files stay splittable."""
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"))
    return r.filter(F.length(F.trim("r")) > 0)


def fasta(spark: SparkSession, path, truncate: bool = True, strip_gaps: bool = True) -> DataFrame:
    """label, seq: lines joined, letters and * kept (gaps too unless stripped); empty sequences are left out."""
    head, body = F.substring_index("r", "\n", 1), F.regexp_extract("r", "(?s)^[^\n]*\n(.*)$", 1)
    label = F.regexp_extract(head, "^(\\S*)", 1) if truncate else F.translate(F.rtrim(head), "\t", " ")
    seq = F.regexp_replace(body, "[^A-Za-z*]" if strip_gaps else "[^A-Za-z*.-]", "")
    return _records(spark, path).select(label.alias("label"), seq.alias("seq")).filter(F.length("seq") > 0)


def fastq(spark: SparkSession, path) -> DataFrame:
    """label, seq, qual of four-line records."""
    r = spark.read.text(path, wholetext=True).select(F.explode(F.expr("regexp_extract_all(value, '@[^\\n]*\\\\n[^\\n]*\\\\n\\\\+[^\\n]*\\\\n[^\\n]*', 0)")).alias("r"))
    return r.select(F.split("r", "\n").alias("l")).select(F.substring(F.col("l")[0], 2, 1 << 30).alias("label"), F.col("l")[1].alias("seq"), F.col("l")[3].alias("qual"))


def _number(k: int):
    return lambda x: x[k].cast("double")  # of one argument: a second one would be the place


def cal(spark: SparkSession, path) -> DataFrame:
    """label, seq, xs, ys, zs of chains as letter and coordinates by tab."""
    rows = F.transform(F.filter(F.split(F.regexp_extract("r", "(?s)^[^\n]*\n(.*)$", 1), "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(x, "\t"))
    d = _records(spark, path).select(F.regexp_extract("r", "^(\\S*)", 1).alias("label"), rows.alias("t"))
    return d.select("label", F.concat_ws("", F.transform("t", lambda x: x[0])).alias("seq"), *[F.transform("t", _number(k)).alias(n) for k, n in ((1, "xs"), (2, "ys"), (3, "zs"))])


#: fixed values: residue names and their letters
THREE = dict(zip("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL MSE".split(), "ARNDCQEGHILKMFPSTWYVM", strict=True))


def pdb(spark: SparkSession, path) -> DataFrame:
    """label (file name and chain), seq, xs, ys, zs and res_nrs of the CA atoms; insertion codes are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), "\\.(pdb|ent)$", "").alias("f"), F.posexplode(F.split("value", "\r?\n")).alias("n", "l"))
    cut = lambda a, z: F.trim(F.substring("l", a, z - a + 1))
    atom = lines.filter("(l LIKE 'ATOM%' OR (l LIKE 'HETATM%' AND substring(l, 18, 3) = 'MSE')) AND substring(l, 27, 1) = ' '").filter(cut(13, 16) == "CA")
    three = F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv])
    a = atom.select("f", "n", F.substring("l", 22, 1).alias("c"), F.coalesce(F.try_element_at(three, cut(18, 20)), F.lit("X")).alias("aa"), *[cut(p, p + 7).cast("double").alias(k) for p, k in ((31, "x"), (39, "y"), (47, "z"))], cut(23, 26).cast("int").alias("nr"))
    a = a.groupBy("f", "c", "nr").agg(F.min_by(F.struct("n", "aa", "x", "y", "z"), "n").alias("v"))
    g = a.groupBy("f", "c").agg(F.array_sort(F.collect_list(F.struct(F.col("v.n").alias("n"), F.col("nr"), F.col("v.aa").alias("aa"), F.col("v.x").alias("x"), F.col("v.y").alias("y"), F.col("v.z").alias("z")))).alias("r"))
    return g.select(F.concat("f", F.lit("_"), "c").alias("label"), F.concat_ws("", "r.aa").alias("seq"), F.col("r.x").alias("xs"), F.col("r.y").alias("ys"), F.col("r.z").alias("zs"), F.col("r.nr").alias("res_nrs"))


def stockholm(spark: SparkSession, path) -> DataFrame:
    """file, label, row: rows of one label joined over the blocks of a file."""
    l_ = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "l")).filter("l RLIKE '^[^#/\\\\s]\\\\S*\\\\s+\\\\S+'")
    s = l_.select("file", "n", F.split("l", "\\s+").alias("p")).groupBy("file", F.col("p")[0].alias("label")).agg(F.array_sort(F.collect_list(F.struct("n", F.col("p")[1].alias("s")))).alias("r"))
    return s.select("file", "label", F.concat_ws("", "r.s").alias("row"))


def stockholm_features(spark: SparkSession, path) -> DataFrame:
    """file, feature, row of the lines about columns (#=GC), joined over the blocks of a file."""
    l_ = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "l")).filter("l RLIKE '^#=GC\\\\s+\\\\S+\\\\s+\\\\S+'")
    s = l_.select("file", "n", F.split("l", "\\s+").alias("p")).groupBy("file", F.col("p")[1].alias("feature")).agg(F.array_sort(F.collect_list(F.struct("n", F.col("p")[2].alias("s")))).alias("r"))
    return s.select("file", "feature", F.concat_ws("", "r.s").alias("row"))


def motif_coords(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="label string, lo_a int, hi_a int, lo_b int, hi_b int, lo_c int, hi_c int")


def edges(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="src string, dst string, w double")


def model(spark: SparkSession, path) -> dict:
    """group -> three profiles in hundredths, from the text format of motif models (a file of bounded size).

    A profile starts at a line PSSM with number, motif and group; its count of columns and of rows must agree, and the
    file's of profiles. A broken file raises."""
    return read_model(r[0] for r in spark.read.text(path).coalesce(1).toLocalIterator())[0]


def read_model(lines) -> tuple[dict, dict]:
    """The profiles and the consensus letters of each group."""
    names, want, out, letters, cur, said, several, ended = {}, None, {}, {}, None, [], None, False
    for v in lines:
        f = v.split("\t") if "\t" in v else v.split()
        key = f[0].lower() if f else ""
        if key == "group" and len(f) > 2:
            names[f[1]] = f[2]
        elif key == "pssms":
            want = int(f[1])
        elif key == "pssm" and len(f) == 4:  # number, motif, group
            cur = out.setdefault(f[3], {}).setdefault(f[2], [])
            said.append((cur, None))
        elif key == "pssm" and len(f) == 3 and f[1] in ("aa", "nt"):
            if f[1] != "aa":
                raise ValueError("a nucleotide profile, where amino acids are wanted")
            said[-1:] = [(cur, int(f[2]))]
        elif key == "pssm":
            cur = out.setdefault(names.get(f[1], f[1]), {}).setdefault(f[2], [])
            said.append((cur, None))
        elif key == "groups" and len(f) == 2:
            several = int(f[1])
        elif key == ".":
            ended = True
        elif key == "consseq" and cur is not None:
            letters[id(cur)] = f[1]
        elif cur is not None and key.isdigit() and len(w := v.split()) >= 22:
            cur.append([round(float(x) * 100) for x in w[1:22]])
    if any(n is not None and n != len(rows) for rows, n in said) or want is not None and want != len(said):
        raise ValueError("the model's counts do not agree with its rows")
    if several is not None and (several != len(out) or not ended):
        raise ValueError("the model ends early or its groups do not agree with its head")
    if any(len(m) != 3 for m in out.values()):
        raise ValueError("a group without its three motifs")
    by = {g: tuple(m[k] for k in sorted(m)) for g, m in out.items()}
    return by, {g: tuple(letters.get(id(rows), "") for rows in ms) for g, ms in by.items()}


def file_list(spark: SparkSession, path) -> list[str]:
    """Paths named one a line (a file of bounded size); blank lines are left out."""
    return [r[0].strip() for r in spark.read.text(path).toLocalIterator() if r[0].strip()]


def six_motif_coords(spark: SparkSession, path) -> DataFrame:
    """label, then place (from 1) and letters of each of the motifs F2, A, B, C, D, E, by tab; a point is a missing one."""
    schema = "label string, " + ", ".join(f"pos_{m} int, seq_{m} string" for m in ("f2", "a", "b", "c", "d", "e"))
    return spark.read.csv(path, sep="\t", schema=schema, nullValue=".")


def aligned_pairs(spark: SparkSession, path) -> DataFrame:
    """a, b, row_a, row_b of pairwise alignments, by tab; rows of two lengths are left out."""
    d = spark.read.csv(path, sep="\t", schema="a string, b string, row_a string, row_b string")
    return d.filter(F.length("row_a") == F.length("row_b"))
