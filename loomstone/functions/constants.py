"""Fixed values that results depend on: word lists, patterns, weights. Stated as they are defined, in their order."""

# Common English words of the naturalness score.
STOPWORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her "
    "she or an will my one all would there their what so up out if about who get which go me when make can like time no "
    "just him know take people into year your good some could them see other than then now look only come its over think also "
    "back after use two how our work first well way even new want because any these give day most us is was are were been "
    "has had did does being am"
).split()

# Patterns of boilerplate and of templates, matched without case.
BOILERPLATE = [
    r"cookie(?:s)?\s+(?:policy|consent|settings)",
    r"subscribe\s+(?:to\s+)?(?:our\s+)?newsletter",
    r"click\s+here\s+to\s+(?:read|learn|subscribe|sign)",
    r"all\s+rights\s+reserved",
    r"terms\s+(?:of\s+)?(?:service|use)|privacy\s+policy",
    r"(?:share|follow)\s+(?:on|us\s+on)\s+(?:twitter|facebook|instagram|linkedin)",
    r"(?:sign\s+up|log\s*in|create\s+(?:an?\s+)?account)",
    r"(?:advertisement|sponsored\s+content|promoted)",
    r"©\s*\d{4}",
    r"loading\.\.\.|please\s+wait",
    r"enable\s+javascript",
    r"your\s+(?:email|e-mail)\s+address",
    r"unsubscribe\s+(?:from|at\s+any\s+time)",
]
TEMPLATES = [r"\{[a-z_]+\}", r"(?i)lorem\s+ipsum", r"(?i)(?:TODO|FIXME|XXX|HACK):"]
URL, EMAIL = r"https?://", r"\S+@\S+\.\S+"

# Weights of the sub-scores.
WEIGHTS = {"length": 0.05, "diversity": 0.15, "sentences": 0.15, "paragraphs": 0.05, "naturalness": 0.15, "capitals": 0.05, "repetition": 0.15, "boilerplate": 0.10, "template": 0.05, "clean": 0.10}

# Damaged punctuation and what it stands for, longest first.
MOJIBAKE = [("â€™", "'"), ("â€œ", '"'), ("â€\x9d", '"'), ("â€“", "-"), ("â€”", "-"), ("â€¦", "..."), ("â€˜", "'"), ("Ã©", "e"), ("â€", '"')]

# Phrases of refusals, by the list that uses them.
REFUSAL_PHRASES = [
    "i am a language model",
    "i am an ai",
    "i'm an ai",
    "i am a computer program",
    "as an ai",
    "as a language model",
    "i cannot answer",
    "i can't answer",
    "i do not have access",
    "i don't have access",
    "i am not able to provide",
    "i am unable to",
    "as an artificial intelligence",
    "i'm just an ai",
    "i'm a language model",
    "i don't have personal",
    "i do not have personal",
    "as a helpful assistant",
    "i am only a",
    "i'm only a",
]
BAD_OPENINGS = [
    "i cannot",
    "i can't",
    "i won't",
    "i will not",
    "i'm sorry",
    "i am sorry",
    "sorry,",
    "i apologize",
    "unfortunately",
    "i'm unable",
    "i am unable",
    "i must decline",
    "i do not feel comfortable",
    "i don't feel comfortable",
    "i'm not sure",
    "i am not sure",
    "i'm afraid i",
    "i am afraid i",
    "i don't know",
    "i do not know",
    "i think ",
    "i believe ",
    "as an ai",
    "as a language model",
    "i'm just an ai",
]
BAD_ANYWHERE = ["my content filter", "violates my", "i am an ai language", "as an ai language"]
IDENTITY = r"(?i)open\s?assistant|chatgpt|openai|anthropic|\bGPT[\s-]?[234je]?\b|<noinput>|<nooutput>|\bnoinput\b|\bnooutput\b|as ai language model"
END_OK = r"""(?m)([.!?"')\]\d%]|```|\|)\s*$|^\s*(?:\d+[.)]|[-*])\s+\S+$"""
WRITE_INTENT = r"(?i)write|essay|story|article|detail|explain .* thoroughly|elaborate|list|describe|compose|draft|poem|paragraphs"
SPAM_USER = r"(?i)here is a piece of text|given the text:|based on the passage above"
GLUED_DOMAINS = r"(?i)(shell cmd|shell command|latex|swift code|c\+\+ code|html page|xml data|excel table|mark down|json data|ruby code|scala|matlab)"

# Marks of the evaluation checks.
HEDGES = ["i'm not sure", "i am not sure", "i think", "i believe", "it's possible", "as far as i know", "i don't know", "i'm not certain"]
IDENTITY_MARKS = ["open assistant", "chatgpt", "openai", "anthropic", "i am gpt", "google assistant"]
SPEAKER = r"(?i)(?:^|\n)\s*(?:User|Assistant|System|Human|Q|A|B|Boy|Girl|Teacher|Student)\s?:"
BAD_MARKS = ["i am an ai assistant", "i am not a human", "i don't have opinions", "as an ai", "i cannot answer", "as a language model"]
STOP_MARKERS = ["\nUser:", "\nAssistant:", "\nQuestion:", "\n\n\n"]
SPEAKER_WORDS = "user assistant system human boy girl man woman teacher student interviewer narrator doctor bot speaker customer agent mom dad friend host guest child kid reporter".split()
