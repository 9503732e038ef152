"""Parameters of the registered queries (shared by the Spark side and the oracle)."""

# "Today" for the day-scoped queries; the reference uses the wall clock, we
# take it as a parameter so runs repeat.
AS_OF_DAY = "2024-01-03"
# A day with no collected article (exercises the empty-day rules).
EMPTY_DAY = "2023-12-31"
# Seed of the md5 order that replaces SQL RANDOM().
SEED = "lexmine"
# Words per chat message.
MESSAGE_WORDS = 3
# Date printed in Markdown notes.
NOTE_DATE = "2024-02-01"
# Single search query (upper case: SQLite LIKE folds ASCII).
SEARCH_QUERY = "MENT"
# Batch of search queries: plain, upper case, wildcards, backslash, accents,
# empty (matches everything) and no match.
SEARCH_QUERIES = (
    "archae", "tion", "MENT", "ab%ly", "inter_a", "\\", "é", "É", "", "qqqzzz", "definition for 'un", "x",
)
