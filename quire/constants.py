"""Word lists and patterns that must equal the published ones."""

# fixed values: the default English list of Spark ML's StopWordsRemover
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll
they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()

# fixed values: patterns for years, centuries and decades in prose
YEAR_PATTERN = r"\b1[0-9]{3}\b|\b20[0-9]{2}\b"
CENTURY_PATTERN = r"\b(?:1[0-9]|20)(?:th|st) century\b"
DECADE_PATTERN = r"\b(?:1[0-9]|20)[0-9]0s\b"

# fixed values: patterns for life dates inside a name
SPAN_PATTERN = r"\b(\d{4})\s*-\s*(\d{4})\b"
BORN_DIED_PATTERN = r"\b[bd]\.\s*(\d{4})\b"
SINGLE_YEAR_PATTERN = r"\b(\d{4})\b"

# fixed values: small opinion lexicon (word, polarity, subjectivity)
OPINION_LEXICON = [
    ("good", 0.7, 0.6), ("bad", -0.7, 0.67), ("great", 0.8, 0.75), ("terrible", -1.0, 1.0),
    ("boring", -1.0, 1.0), ("amazing", 0.6, 0.9), ("and", 0.1, 0.2), ("the", -0.05, 0.1),
    ("there", 0.2, 0.4), ("other", -0.12, 0.38), ("der", 0.15, 0.3), ("que", -0.2, 0.5),
]

# fixed values: words that flip the polarity of the next word
NEGATIONS = ["not", "no", "never", "on", "ne", "nicht"]

# fixed values: words counted as easy by the readability grade that needs a list
EASY_WORDS = ["the", "and", "of", "to", "in", "is", "on", "at", "by", "for", "with", "that", "this",
              "are", "was", "her", "his", "she", "they", "there", "then", "we", "you", "it", "as"]
