"""Word lists and weights.  Every operator takes them as parameters; these are the defaults."""

from __future__ import annotations

# They must equal the known word lists for equal results.
STOP_WORDS = (
    "a an and are at be been by can did do does for from had has have how i in is it me my of on or our that the their "
    "them then there these they this to was we were what when where which who why will with would you your"
).split()
KEYWORD_STOP_WORDS = (
    "the and for are but not you all can has had was were been have this that with from they will would could should what "
    "when where which who how why your our their there here then than into onto upon"
).split()
PHRASE_STOP_WORDS = (
    "i you he she it we they me my your his her our their the a an is am are was were be been have has had do does did to of "
    "in for on with at by from up about into over after yeah yes no yep thanks thank hey hi hello wow so that this there then "
    "just really very much too also and but or if what when where how why who which will would can could should here some "
    "other stuff like got good great awesome nice sounds super well talk soon see know think thought sure fine okay right"
).split()
IRREGULAR_STEMS = {
    "bought": "buy", "made": "make", "went": "go", "ran": "run", "seen": "see", "saw": "see", "met": "meet", "held": "hold",
    "read": "read", "taken": "take", "took": "take", "given": "give", "gave": "give", "chosen": "choose", "chose": "choose",
    "written": "write", "wrote": "write", "spoken": "speak", "spoke": "speak", "taught": "teach", "heard": "hear",
    "married": "marry", "marriage": "marry",
}
TEMPORAL_TYPES, STATE_TYPES, COMPOSITION_TYPES = ["temporal", "temporal-reasoning"], ["knowledge-update"], ["multi-hop", "multi-session"]
TEMPORAL_QUESTIONS = ["how many days", "how many weeks", "how many months", "order from first to last", "which event happened first"]
STATE_QUESTIONS = ["currently", "now", "previously", "used to", "updated"]
COMPOSITION_QUESTIONS = ["where did", "why did", "what country", "who is", "how did"]
RECENCY_QUESTIONS = ["recent", "now", "current", "currently", "latest", "updated"]
MONEY_QUESTIONS = ["money", "spent", "spend", "cost", "price", "dollar", "$", "expense", "expenses", "fee", "pay", "paid"]
MONEY_FOCUS = ["bike", "hotel", "car", "trip", "plant", "doctor", "clothing", "clothes", "shoe", "shoes"]
COUNT_QUESTIONS = ["how many", "how much", "total", "count"]
QUANTITY = r"\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)\b"
DIRECT_RELATIONS = ["asserts", "prefers", "located_at"]
IR_PATTERNS = {
    "decision": r"decid\w+|choos\w+|select\s+\w+|adopt\s+\w+|reject\s+\w+|go with|settle on|finaliz\w+",
    "reasoning": "because|reason|since|therefore|thus|logic|rationale|why",
    "temporal": "now|today|yesterday|tomorrow|later|before|after|currently|recently|earlier|soon|eventually|finally|first|then|next",
    "state": "status|current|state|progress|done|pending|complete|in progress|finished|working on",
    "concern": "concern|risk|issue|problem|worry|afraid|scared|danger|threat|vulnerab",
    "tradeoff": "tradeoff|trade-off|pros and cons|advantage|disadvantage|benefit|drawback|upside|downside",
    "agreement": "agree|consensus|aligned|same page|on board|support|approve",
    "action": "will|should|need to|must|have to|action|todo|next step|follow up",
    "knowledge": "fact|define|definition|concept|principle|theorem|rule|law",
}
# Kinds whose pattern may stand inside a word; the others start and end at a word boundary.
IR_INSIDE_WORDS = ["decision", "reasoning"]
CASUAL = ["yeah", "ok", "okay", "sure", "cool", "awesome", "great", "nice", "right", "got it", "makes sense"]
HESITATION = ["um", "uh", "er", "ah", "hmm", "well", "maybe", "perhaps", "not sure", "i think", "i guess", "sort of", "kind of"]
ENTITY_STOP_WORDS = (
    "The This That These Those An And But If Then Else When Where Why How What Who Let You Are Was Were Been Have Has Had Does "
    "Did Will Would Could Should May Might Must Can Need Want Like Just Also Even Still Already Yet Not Yes Okay Sure Right "
    "Good Great Fine Agreed Done Now Here There Down Out Off"
).split()
IR_PRIORITY = {
    "decision": 10, "reasoning": 9, "concern": 8, "tradeoff": 8, "agreement": 7, "action": 7, "state": 6, "topic": 6,
    "knowledge": 5, "entity": 5, "temporal": 4, "tone": 3, "role": 2,
}
IR_ORDER = ["role", "topic", "entity", "tone", "decision", "reasoning", "concern", "tradeoff", "agreement", "action", "state", "temporal", "knowledge"]
DEFAULT_IMPORTANCE = {"decision": 0.85, "current": 0.9, "timeline": 0.7, "episode": 0.65, "semantic": 0.7, "conversation_style": 0.5}
DEFAULT_CONFIDENCE = {"decision": 0.85, "current": 0.95, "timeline": 0.75, "episode": 0.75, "semantic": 0.8, "conversation_style": 0.7}
DECISION_WORDS = ["決めた", "決定", "採用", "却下", "選択", "選んだ", "decided", "adopted", "rejected", "selected", "chose", "go with", "decid", "adopt"]
IMPORTANT_WORDS = ["重要", "大事", "必須", "important", "critical", "must", "risk", "suggested", "status"]
COMPRESS_MARKERS = [
    ["決めた", "決定", "採用", "却下", "選択", "選んだ", "決断"],
    ["理由", "なぜ"],
    ["重要", "大事", "クリティカル", "必須", "マスト"],
    ["問題", "課題", "懸念", "リスク", "不安"],
    ["メリット", "利点", "欠点", "長所", "短所"],
    ["比較", "検討", "トレードオフ"],
    ["アーキテクチャ", "設計", "方針"],
]
COMPRESS_FILLER = "だと思う|気がする|と思う|でしょうか|ですよね|じゃないですか|えーっと|えーと|うーん|なんか|一応|w{2,}|笑|草"
COMPRESS_DECISION = ["決めた", "決定", "採用", "却下", "選択", "選んだ"]
COMPRESS_REASON = ["理由", "なぜ", "ため", "から"]
VALIDATION_DECISION = ["決めた", "決定", "採用", "却下", "選択", "選んだ", "決断", "decided", "adopted", "rejected", "selected", "chose", "go with"]
VALIDATION_FILLER = "the a an and or but is was are were to of in on for with by as at from it this that these those we you they i".split()
TOPIC_KEYWORDS = {
    "architecture": ["architecture", "architectural", "design pattern", "system design", "microservice", "monolith", "scalability"],
    "database": ["database", "sql", "nosql", "postgres", "mysql", "sqlite", "migration", "schema", "query", "index"],
    "api": ["api", "rest", "graphql", "grpc", "endpoint", "request", "response", "swagger", "openapi"],
    "frontend": ["frontend", "react", "vue", "svelte", "component", "ui", "ux", "css", "html", "typescript"],
    "backend": ["backend", "server", "service", "worker", "queue", "async", "concurrency", "thread"],
    "testing": ["test", "testing", "unit test", "integration test", "e2e", "mock", "pytest", "jest", "coverage"],
    "deployment": ["deploy", "deployment", "ci/cd", "pipeline", "docker", "kubernetes", "k8s", "helm", "terraform"],
    "security": ["security", "auth", "authentication", "authorization", "oauth", "jwt", "encryption", "vulnerability"],
    "performance": ["performance", "optimization", "latency", "throughput", "bottleneck", "profiling", "benchmark"],
    "ai/ml": ["machine learning", "ml", "ai", "model", "training", "inference", "llm", "embedding", "vector", "rag"],
    "project-management": ["project", "task", "sprint", "backlog", "kanban", "jira", "roadmap", "milestone"],
    "code-review": ["review", "pr", "pull request", "merge", "diff", "comment", "approval", "change"],
    "debugging": ["debug", "bug", "error", "exception", "stack trace", "log", "issue", "fix", "crash"],
    "refactoring": ["refactor", "cleanup", "technical debt", "legacy", "modernize", "rewrite", "improve"],
    "documentation": ["document", "readme", "docstring", "comment", "wiki", "specification", "adr"],
}
STYLE_FILLERS = ["um", "uh", "er", "ah", "hmm", "well", "like", "you know", "basically", "actually", "literally"]
STYLE_HESITATIONS = ["um", "uh", "er", "ah", "hmm", "well", "let me think", "let me see"]
STYLE_EMOTIONS = {
    "excited": [r"[!！]{2,}", "わーい|やったー|すごい|amazing|awesome|great"],
    "frustrated": [r"[?？]{2,}", "なぜ|どうして|why|困った|むずかしい|difficult|impossible"],
    "uncertain": ["かも|かもしれない|maybe|perhaps|probably|not sure|分からない|unknown"],
    "confident": ["確実|certain|definitely|absolutely|間違いなく|sure"],
    "polite": ["です|ます|please|thank you|ありがとうございます|失礼"],
    "casual": ["だね|だよ|だわ|じゃん|だよね|yeah|ok|okay|sure|cool|nice"],
}
PERSONA_ROLES = "user owner photographer cyclist developer researcher comedian baker cook musician runner traveler writer".split()
PERSONA_VAGUE = ["that", "this", "it", "them", "these", "those", "the idea of", "the sound of", "how ", "what "]
PERSONA_DOMAINS = {
    "web": ["view", "click", "page"],
    "shop": ["purchase", "cart", "items", "plan"],
    "account": ["login", "signup", "logout", "error"],
}
ABSTENTION_MARKERS = [
    "i don't know", "i do not know", "don't know", "not enough information", "insufficient information", "no information",
    "not specified", "not mentioned", "no mention", "cannot determine", "can't determine", "cannot be determined",
    "unable to determine", "cannot say", "no evidence", "not in the context", "there is no information", "unknown",
]
PLANNER_RULES = [
    ("temporal_delta", ["how many days", "how many weeks", "how many months", "between"]),
    ("temporal_order", ["order from first to last", "which event happened first", "earlier", "later"]),
    ("state_update", ["currently", "now", "previous", "previously", "used to", "before", "updated"]),
    ("user_preference", ["recommend", "suggest", "any suggestions", "ideas for", "complement my", "prefer", "favorite"]),
    ("adversarial_check", ["^did [a-z]+"]),
    ("multi_hop", ["where did", "why did", "what country", "who is", "how did"]),
]
INTENT_RULES = [
    ("reflection", ["recurring preference", "consistently show", "tendency", "habit", "prefer", "preference", "what does the user show", "considering everything"]),
    ("evidence", ["who proposed", "who suggested", "at any point", "did someone suggest", "was there a proposal", "did the user propose"]),
    ("event", ["how did", "transition", "evolve", "timeline", "chronology", "migrated from", "history of", "sequence of changes"]),
    ("aggregation", ["how many", "how much", "total", "combined", "in total", "altogether", "sum of", "average", "how long"]),
]
RECALL_PHRASES = [
    "remind me", "our previous chat", "our previous conversation", "previous conversation about", "previous chat about",
    "looking back at", "we discussed", "you mentioned", "you provided", "you recommended", "you created", "you said", "did you say",
]
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
# End of fixed values.

# Words of a conversation that do not describe what is asked, and words that stand for each other.
CONVERSATION_STOP_WORDS = [
    "can", "you", "could", "would", "suggest", "recommend", "some", "that",
    "what", "which", "how", "about", "tell", "give", "help", "with", "for",
    "the", "and", "are", "have", "been", "was", "were", "any", "does", "did",
    "will", "shall", "should", "might", "must", "may", "there", "this",
    "different", "items", "item", "need", "needs", "needed", "store", "stores",
    "tips", "good", "new", "also", "like", "make", "sure", "start", "started",
    "keep", "kept", "find", "visit", "visited", "visiting",
]
DOCTOR_WORDS = ["doctor", "doctors", "dr", "physician", "physicians", "specialist", "specialists", "dermatologist", "ent"]
CLOTHING_WORDS = ["clothing", "clothes", "blazer", "boots", "jacket", "jeans", "shirt", "pants", "dress", "sweater"]
PLANT_WORDS = ["plant", "plants", "lily", "succulent", "fern", "basil", "snake"]
SYNONYMS = {
    "doctor": DOCTOR_WORDS, "doctors": DOCTOR_WORDS,
    "clothing": CLOTHING_WORDS, "clothes": CLOTHING_WORDS,
    "plant": PLANT_WORDS, "plants": PLANT_WORDS,
}
