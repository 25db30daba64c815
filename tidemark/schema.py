"""The columns of alignment records, and the names of the buckets beside the references."""

DISCORDANT, UNMAPPED = "discordant", "unmapped"

#: Mandatory fields of a record, in order; what follows them is one column, ``tags``.
FIELDS = (
    ("qname", "string"),
    ("flag", "int"),
    ("rname", "string"),
    ("pos", "bigint"),
    ("mapq", "int"),
    ("cigar", "string"),
    ("rnext", "string"),
    ("pnext", "bigint"),
    ("tlen", "bigint"),
    ("seq", "string"),
    ("qual", "string"),
)
MAPQ_MOST = 255
