"""Word lists, patterns and limits that results depend on."""

# They must equal those of the engine whose results are matched.

#: Words that make no phrase a tic.
FUNCTION_WORDS = """
a an and as at be been but by did do for from had has have he her him his i if in is it its me my not of on or our out she
so than that the their them then there they this to up was we were what when which who will with would you your am are no
nor into over under again more most such only own same too very can could should now here how all
""".split()
FILTER_VERBS = """
saw see sees seeing heard hear hears hearing felt feel feels feeling noticed notice notices noticing realized realize
realizes realizing realised realise realises realising watched watch watches watching wondered wonder wonders wondering
thought think thinks thinking knew know knows knowing
""".split()
#: Words in -ly that are no adverbs.
NOT_ADVERBS = """
family only early holy ally supply apply rely imply reply comply multiply monopoly anomaly assembly fly butterfly likely
unlikely friendly unfriendly lonely lovely lively homely orderly disorderly costly deadly ghostly kindly unkindly leisurely
lowly manly womanly monthly weekly yearly daily hourly elderly stately timely untimely goodly gadfly dragonfly belly bully
silly jolly folly rally chilly ugly
""".split()
WATCH_PHRASES = ["exactly", "particular", "my own", "I did not", "I do not know", "I have come to believe", "this account", "I have thought", "I understood", "I decided", "the truest thing"]
MODERN_WORDS = """
liability oversight governance apparatus configuration formalized formalised installments instalments protocol
infrastructure logistics parameters framework leverage process boundaries closure trauma self-worth validate prioritize
prioritise dynamic systemic optimize optimise
""".split()
OPENERS = ["I did not", "I do not", "I want to", "I have", "It was", "There was"]
TAG_VERBS = """
said asked replied answered told whispered shouted murmured muttered exclaimed cried retorted snapped hissed growled drawled
sighed breathed admitted continued added interrupted insisted protested demanded offered suggested warned agreed countered
argued laughed chuckled grumbled stammered sneered
""".split()
QUALIFIERS = "perhaps maybe possibly somewhat rather quite seems seemed suppose believe think might".split()
ABSTRACT = r"\b(truth|memory|faith|love|fear|grief|hope|time|history|meaning|forgiveness|silence|mercy|courage|loss)\b"
CONCRETE = r"\b(hand|hands|door|gate|stair|step|bread|flour|water|floor|table|cloth|linen|jar|lamp|oil|dust|blood|wall|roof|knee|foot|feet|stood|sat|walked|opened|closed|carried|poured|washed|set|put)\b"
SIMILE = r"(?i)\b(?:like (?:a|an|the)\s+[\w'-]+(?:\s+[\w'-]+){0,4}|as if\s+[\w'-]+(?:\s+[\w'-]+){0,4}|the way\s+[\w'-]+(?:\s+[\w'-]+){0,4})"
NOT_BUT = r"(?i)\bnot\s+[^.,;]{1,40}?\s+but\s+"
EXTENSION = r"(?i)\bnot because\b|\bnot\s+[^.,;]{1,40}?,\s*but\b|\bthe kind of\b[^.!?]{1,60}\bthat\b"
FOUND_SELF = r"(?i)\bfound\s+(?:herself|himself|themselves|myself)\b"
LINE_DEFECTS = [
    (r",\s*[—–-]{1,2}\s", "comma immediately before a dash"),
    (r"\s[—–]\s*,", "dash immediately before a comma"),
    (r"[!?]{2,}", "repeated terminal punctuation"),
    (r"[“”\"][^“”\"]{0,3}[“”\"]", "empty or near-empty quotation"),
]
#: Signs of a text decoded twice; one of them ends with a control character.
MOJIBAKE = ["Ã¢â‚¬", "Ã©", "â€™", "â€œ", "â€" + chr(0x9D), "�"]
SCENE_BREAK = r"^\s*([*#~\-]{3,}|[*#~\-]\s*[*#~\-]\s*[*#~\-])\s*$"
CHAPTER_HEADING = r"^#{1,2}\s*Chapter\s+([0-9]+)\b"
TEXTURE_KINDS = ["place", "object", "jargon", "price", "weather"]
#: Chapters from which a shared shape says anything, and the share over which it is a template.
MACRO_CHAPTERS, MACRO_SHARE, MACRO_TITLES = 6, 0.5, 3
#: Limits of the lint checks by name; profiles override some.
THRESHOLDS = {
    "em_dash_per_1k": 4.0,
    "phrase_per_10k": 8.0,
    "not_x_but_y_per_10k": 6.0,
    "explanatory_extension_per_1k": 0.6,
    "opener_share": 0.12,
    "maxim_ending_share": 0.67,
    "length_cv": 0.30,
    "min_chapter_words": 200,
    "ngram_min_count": 5,
    "ngram_per_10k": 4.0,
    "fk_grade_min": 4.0,
    "fk_grade_max": 10.0,
    "sentence_len_min": 11.0,
    "sentence_len_max": 26.0,
    "dialogue_ratio_min": 0.15,
    "dialogue_ratio_max": 0.62,
    "sentence_cv_min": 0.35,
    "sentence_monotony_min_sentences": 8,
    "escalation_min_last_per_1k": 0.4,
    "escalation_ratio": 2.5,
    "adverb_per_1k": 10.5,
    "filter_word_per_1k": 6.0,
    "min_tag_sample": 20,
    "said_tag_share_min": 0.6,
    "echo_window_words": 50,
    "echo_min_word_len": 5,
    "echo_per_10k": 3.0,
    "opener_repeat_run_min": 3,
    "local_density_multiplier": 1.5,
    "local_density_min_words": 500,
}
_HISTORICAL = {"em_dash_per_1k": 3.5, "phrase_per_10k": 7.0, "fk_grade_min": 7.0, "fk_grade_max": 9.0, "sentence_len_min": 16.0, "sentence_len_max": 24.0, "dialogue_ratio_min": 0.25, "dialogue_ratio_max": 0.40, "explanatory_extension_per_1k": 0.5}
_COMMERCIAL = {"em_dash_per_1k": 6.0, "phrase_per_10k": 12.0, "fk_grade_max": 8.0, "sentence_len_min": 12.0, "sentence_len_max": 22.0, "dialogue_ratio_min": 0.30, "explanatory_extension_per_1k": 0.8}
PROFILES = {
    "literary": {"em_dash_per_1k": 3.0, "phrase_per_10k": 6.0, "explanatory_extension_per_1k": 0.5},
    "commercial": _COMMERCIAL,
    "thriller": _COMMERCIAL | {"sentence_len_min": 10.0, "sentence_len_max": 20.0},
    "historical": _HISTORICAL,
    "biblical": _HISTORICAL,
}

# Fixed values of the score rules, by genre where they differ.

#: Weights of the ten gated dimensions.
DIMENSION_WEIGHTS = {"originality": 1.1, "theme": 1.0, "characters": 1.2, "prose": 1.0, "pacing": 1.0, "emotion": 1.1, "cohesion": 0.9, "market": 0.8, "voice": 1.1, "ending": 0.8}
#: Floor, average and least score of an approved board; distance of commercial index and floor, and of average and floor.
BOARD_FLOOR, BOARD_AVERAGE, BOARD_LEAST, DIVERGENCE, BOTTLENECK = 8.5, 9.0, 8.0, 2.0, 1.0
#: Floors under which a chapter is broken, and the floor and casual score of a pass.
HARD_FLOORS = {"literary": 7.5, "commercial": 7.0, "thriller": 7.0, "memoir": 7.5, "prescriptive": 7.0}
PASS_FLOOR = PASS_CASUAL = 8.5
#: genre: floor, patterns, explanatory extensions and em dashes of a chapter that passes its gate.
GATE_LIMITS = {"literary": (7.5, 3, 3, 3), "memoir": (7.5, 4, 3, 5), "commercial": (7.0, 8, 6, 8), "thriller": (7.0, 8, 6, 8), "prescriptive": (6.5, 12, 8, 15), "first_draft": (6.5, 15, 10, 20)}
#: genre: most patterns of a clean and of a watched chapter.
PATTERN_BANDS = {"literary": (3, 6), "memoir": (4, 7), "commercial": (8, 11), "prescriptive": (12, 15)}
#: Patterns that are at home in prescriptive books and weigh half there.
ENDEMIC_PATTERNS = [7, 11, 15, 16, 18, 19]
#: genre: explanatory extensions, and extensions per 1,000 words, over which prose is capped.
EXTENSION_CAPS = {"literary": (3, 0.5), "memoir": (4, 0.6), "commercial": (6, 0.8), "prescriptive": (8, 1.0)}
PROSE_CAP = 7.5
#: engagement: originality, theme, vocabulary, re-reading, identity, framework.
LEGACY_WEIGHTS = {"default": (0.30, 0.25, 0.20, 0.15, 0.10, 0.0), "aspiration": (0.20, 0.20, 0.20, 0.15, 0.25, 0.0), "prescriptive": (0.15, 0.15, 0.20, 0.15, 0.10, 0.25)}
#: genre: least hook and pull of a chapter; the first chapter's hook needs one more.
HOOK_PULL = {"thriller": (8, 8), "literary": (6, 6), "commercial": (7, 7), "memoir": (6, 7), "romance": (7, 7), "prescriptive": (6, 6)}
#: genre: accepted words of a book.
BOOK_WORDS = {"memoir": (60000, 90000), "literary": (80000, 95000), "thriller": (70000, 100000), "romance": (75000, 100000), "nonfiction": (50000, 80000)}
#: kind of sample: how many a voice bank needs at least.
VOICE_SAMPLES = {"any": 10, "voice-breaking": 3, "irrelevant-thought": 2}
FORMULAS = {
    "not because": r"not because.*but because",
    "the kind of": r"the kind of \w+ that",
    "not as": r"not as \w+ but as",
    "there was something": r"there was something \w+ about",
    "it was the sort": r"it was the (sort|kind|type) of",
    "as if were": r"as if .{5,40} were",
    "doubled abstracts": r"(grief|loss|pain|joy|love|fear|hope|shame|guilt|rage) and (grief|loss|pain|joy|love|fear|hope|shame|guilt|rage)",
}
FORBIDDEN_WORDS = "palpable tangible visceral whilst gaze orbs ministrations utilize plethora myriad ubiquitous dichotomy juxtaposition paradigm trajectory".split()
SAFE_WORDS = {"utilize": "use", "whilst": "while", "upon": "on", "commence": "begin", "endeavor": "try"}
MARKERS = {
    "weekday": r"(?i)\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    "relative": r"(?i)\b(yesterday|tomorrow|last week|next week|three days|two weeks|a month|next morning)\b",
    "later": r"(?i)\b(hours? later|days? later|weeks? later|months? later|years? later)\b",
    "that time": r"(?i)\b(that (morning|afternoon|evening|night))\b",
    "date": r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d",
    "day and month": r"\b\d{1,2}/\d{1,2}\b",
    "year": r"\b(19|20)\d{2}\b",
    "season": r"(?i)\b(spring|summer|autumn|fall|winter)\b",
    "time of day": r"(?i)\b(dawn|sunrise|morning|noon|midday|afternoon|dusk|sunset|evening|night|midnight)\b",
    "device": r"(?i)\b(phone|cell|mobile|smartphone|iphone|android|app|wifi|internet|email|text|GPS)\b",
    "machine": r"(?i)\b(computer|laptop|tablet|printer|fax|typewriter)\b",
    "service": r"(?i)\b(google|uber|instagram|facebook|twitter|whatsapp|zoom|facetime)\b",
    "broadcast": r"(?i)\b(TV|television|radio|streaming|netflix|youtube)\b",
    "street": r"(?i)\b(street|avenue|road|highway|boulevard|plaza|square)\b",
    "direction": r"(?i)\b(north|south|east|west|left|right|across|behind|above|below)\b",
    "distance": r"(?i)\b(miles?|kilometers?|blocks?|minutes? (away|drive|walk))\b",
    "money": r"(?i)\b(dollar|euro|real|reais|pound|cent|money|cash|salary|rent|price|cost|paid|owe)\b",
    "amount": r"\$\d|R\$\d|\d+\s*(dollars?|euros?|reais)",
}

# Fixed values of gates and state events.

GATE_CHECKS = "timeline lint chapter_order wordcount proof book_meta epub macro texture human_pass voice_lexicon structure_variety dynamic_range".split()
ADVISORY_CHECKS = ["macro", "texture", "voice_lexicon", "dynamic_range"]
#: Checks with word lists of English, skipped for other languages.
ENGLISH_CHECKS = ["lint", "macro"]
#: Event type and the blocks of the state that it may write; the block of scores goes by a name of our own.
EVENT_BLOCKS = {
    "phase-advance": ["phase"],
    "chapter-draft": ["chapters"],
    "chapter-revision": ["chapters", "revision_cycles"],
    "evaluation-update": ["score", "commercial_viability", "evaluation_tracking", "quality_gate", "systemic_patterns"],
    "entity-update": ["continuity"],
    "continuity-update": ["continuity"],
    "research-update": ["project"],
    "human-feedback": ["human_feedback"],
    "voice-baseline": ["voice_bank", "voice_dna"],
    "reader-persona-update": ["reader_personas"],
    "reader-evidence": ["evaluation_tracking"],
    "mechanical-preprocess": ["mechanical_preprocess"],
    "package-update": ["decisions"],
    "decision": ["decisions"],
    "adoption": ["project", "chapters"],
    "human-pass": ["human_pass"],
    "config-update": ["runtime"],
}
#: Event types that apply only with a human's approval.
APPROVED_EVENTS = ["phase-advance", "package-update", "human-pass"]
