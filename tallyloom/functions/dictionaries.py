"""Word lists, labels and bands that results depend on, stated in their natural order."""

INTENTS = ["definition", "explanation", "comparison", "procedure", "reasoning"]
DIFFICULTIES = ["easy", "medium", "hard"]
TOPICS = ["OS", "DBMS", "CN", "OOP", "DSA", "General"]

QUESTION_PREFIXES = ["what", "explain", "compare", "how", "why", "difference", "describe", "define", "implement", "design", "write"]

TOPIC_TERMS = {
    "OS": ["deadlock", "process", "thread", "semaphore", "scheduler", "paging", "kernel", "os", "operating system", "context switch", "context switching", "starvation", "critical section", "mutex", "virtual memory", "page fault", "interrupt"],
    "DBMS": ["database", "normalization", "sql", "acid", "schema", "transaction", "transactions", "dbms", "query", "foreign key", "primary key", "index", "indexing", "join", "view", "stored procedure", "b+ tree", "b-tree", "oltp", "olap", "nosql", "relational", "mvcc"],
    "CN": ["tcp", "udp", "network", "networking", "cn", "computer network", "ip", "dns", "http", "https", "router", "subnet", "osi", "handshake", "gateway", "firewall", "mac address", "port", "dhcp", "routing", "bandwidth", "latency"],
    "OOP": ["class", "object", "oop", "object oriented", "polymorphism", "polymor", "inheritance", "encapsulation", "abstraction", "interface", "constructor", "method", "overloading", "overriding", "solid", "design pattern", "singleton", "garbage collection", "jvm", "abstract class"],
    "DSA": ["dsa", "data structure", "array", "linked list", "search", "sort", "sorting", "algorithm", "hash", "hashing", "hash map", "hashmap", "hash table", "tree", "graph", "queue", "stack", "traversal", "binary", "dynamic programming", "dp", "greedy", "backtracking", "recursion", "memoization", "trie", "heap", "priority queue", "bfs", "dfs", "dijkstra", "complexity", "time complexity", "space complexity", "big o", "amortized", "sliding window", "two pointer", "divide and conquer"],
}

HARD_VERBS = ["implement", "design", "build", "create", "optimize", "architect", "derive", "prove"]
HARD_SUBJECTS = ["architecture", "distributed"]

ANSWER_KEYWORDS = {
    "OS": ["process", "thread", "memory", "cpu", "interrupt", "scheduling", "deadlock", "paging", "virtual", "context", "operating", "system", "os", "kernel", "program", "resource", "hardware"],
    "DBMS": ["database", "query", "schema", "transaction", "index", "sql", "table", "record", "data", "manage", "store", "retrieve", "dbms", "relation", "acid"],
    "CN": ["network", "protocol", "packet", "routing", "bandwidth", "latency", "tcp", "udp", "ip", "communication", "data", "device", "connection", "internet"],
    "OOP": ["class", "object", "inheritance", "polymorphism", "encapsulation", "method", "property", "oop", "programming", "instance", "attribute", "abstraction"],
    "DSA": ["array", "linked", "tree", "graph", "sort", "search", "stack", "queue", "algorithm", "data", "structure", "dsa", "efficiency", "complexity"],
    "General": ["algorithm", "problem", "solution", "approach", "technique"],
}

VERB_STEMS = ["is ", "are ", "be ", "manag", "handle", "provid", "perform", "involv", "mean", "refer", "call", "use", "contain", "describ", "explain", "show", "keep", "store", "controll", "creat", "allocat"]
CODE_MARKS = ["(", ")", "{", "}", "<<", ">>", ";", "//"]
BONUS_STOP_WORDS = ["a", "an", "the", "is", "are", "be", "in", "of", "to", "for", "and", "or", "it", "that", "this", "by", "on", "at", "as", "with", "from"]
BANK_STOP_WORDS = ["what", "is", "explain", "describe", "compare", "how", "why", "the", "a", "an", "do", "does", "give", "example", "list"]
BANK_SYNONYMS = {"greedy": "greedy algorithm", "greedyalgorithm": "greedy algorithm", "activityselection": "activity selection"}
BANK_BOOST_WORDS = ["greedy", "greedy algorithm", "activity"]

CUES = {
    "comparison": ["vs", "compare", "difference", "similar", "same", "unlike", "while"],
    "procedure": ["step", "then", "first", "next", "finally", "1.", "2.", "->", "process"],
    "reasoning": ["because", "reason", "since", "therefore", "thus", "why", "how", "caused", "due to"],
}

#: (least word count, score) rows of each regime, first match wins; the last row takes the rest.
DEPTH_PARTIAL = {
    "definition": [(10, 55), (5, 45), (0, 30)],
    "explanation": [(15, 55), (10, 45), (5, 35), (0, 25)],
    "other": [(10, 50), (5, 40), (0, 25)],
}
DEPTH_GOOD = {
    "definition": [(30, 100), (20, 95), (15, 92), (10, 88), (8, 82), (5, 78), (3, 65), (0, 50)],
    "explanation": [(30, 100), (25, 95), (15, 90), (10, 85), (5, 70), (0, 50)],
    "comparison": [(20, 95), (15, 90), (8, 80), (0, 70)],
    "procedure": [(25, 95), (15, 90), (10, 80), (0, 70)],
    "reasoning": [(20, 95), (15, 90), (8, 80), (0, 65)],
    "other": [(20, 95), (15, 90), (10, 85), (8, 80), (5, 70), (0, 60)],
}

MISSING_DEPTH = {
    "explanation": "More detailed explanation",
    "procedure": "Step-by-step process description",
    "comparison": "Comparison of key aspects",
    "reasoning": "Logical reasoning or justification",
}

GIBBERISH = ["routing packet", "xxxx", "asdf", "qwerty", "zzzzz", "blah", "bla bla", "idk", "dunno", "no idea", "random", "whatever", "test", "hello world", "lol", "haha", "wtf", "omg"]

ACRONYMS = {
    "syn": "synchronize",
    "ack": "acknowledge",
    "fin": "finish",
    "rst": "reset",
    "syn-ack": "synchronize-acknowledge",
    "synack": "synchronize-acknowledge",
    "synack packet": "synchronize-acknowledge packet",
    "syn packet": "synchronize packet",
    "synchronize packet": "syn packet",
    "tcp": "transmission control protocol",
    "ip": "internet protocol",
    "dns": "domain name system",
    "dhcp": "dynamic host configuration protocol",
    "bgp": "border gateway protocol",
    "ospf": "open shortest path first",
}

ALLOWED_DOMAINS = ["wikipedia.org", "geeksforgeeks.org", "tutorialspoint.com", "javatpoint.com", "sciencedirect.com", "ieee.org", "stackoverflow.com"]
BLOCKED_URL_WORDS = ["quiz", "mcq", "practice", "test", "question", "exam"]
RELEVANCE_TERMS = ["process", "algorithm", "memory", "cpu", "thread", "database", "network", "operating system", "data structure", "synchronization", "deadlock"]
DROPPED_TAGS = ["script", "style", "nav", "footer", "header"]
#: Those of them whose content is no markup.
RAW_TAGS = ["script", "style"]

GATE_STARTERS = ["what", "how", "why", "describe", "explain", "compare", "discuss"]
GATE_BAD_WORDS = ["generate", "create", "context", "material", "explain this"]
RANK_STARTERS = ["what", "how", "why", "describe", "explain", "compare"]
RANK_BAD_WORDS = ["generate", "create", "context", "material"]

SECTION_HEADERS = {
    "summary": ["PROFESSIONAL\\s+SUMMARY", "SUMMARY", "OBJECTIVE", "PROFILE"],
    "experience": ["WORK\\s+EXPERIENCE", "EXPERIENCE", "EMPLOYMENT", "PROFESSIONAL\\s+EXPERIENCE", "WORK\\s+HISTORY"],
    "skills": ["SKILLS", "TECHNICAL\\s+SKILLS", "COMPETENCIES", "CORE\\s+COMPETENCIES"],
    "education": ["EDUCATION", "EDUCATIONAL\\s+BACKGROUND", "QUALIFICATIONS"],
    "certifications": ["CERTIFICATIONS", "LICENSES", "CREDENTIALS", "AWARDS"],
}
COMPANY_MARKS = ["inc", "llc", "ltd", "corp", "experience"]

EXPERIENCE_LEVELS = [("Junior", 0.0, 2.0), ("Mid", 2.0, 5.0), ("Senior", 5.0, float("inf"))]
EMBEDDING_WEIGHT, CLASSIFIER_WEIGHT = 0.4, 0.6

STRONG_EASY_PREFIXES = ["what is ", "what are ", "define ", "what do ", "what does "]
STRONG_HARD_PREFIXES = ["design ", "implement ", "build ", "derive ", "prove ", "optimize "]

CALIBRATION_TERMS = {
    "DBMS": ["dbms", "database management", "database", "databases", "relational", "sql", "schema", "schemas", "table", "tables", "normalization", "foreign key", "primary key", "transaction", "transactions", "orm", "entity", "entities", "column", "columns"],
    "DSA": ["dsa", "data structure", "data structures", "array", "arrays", "hash", "hashing", "hash map", "hashmap", "hash table", "linked list", "stack", "queue", "tree", "trees", "graph", "graphs", "sorting", "sort", "traversal", "traversals", "recursion", "heap", "binary search", "complexity", "dynamic programming", "dp", "greedy", "backtracking", "memoization", "bfs", "dfs", "dijkstra", "trie", "priority queue", "big o", "amortized", "sliding window", "two pointer", "divide and conquer", "algorithm", "algorithms"],
    "OOP": ["oop", "object oriented", "class", "object", "inheritance", "polymorphism", "polymorjpis", "polymor", "encapsulation", "abstraction", "interface", "constructor", "method", "overloading", "overriding", "solid"],
    "OS": ["os", "operating system", "process", "thread", "deadlock", "starvation", "semaphore", "scheduling", "paging", "critical section", "kernel", "context switch", "context switching"],
}

KEY_POINTS = {
    "explanation": ["Detailed mechanism or process", "Step-by-step explanation", "Why it's important", "Related concepts"],
    "comparison": ["Identify at least 2 key differences", "Identify at least 2 key similarities", "Pros/cons of each concept", "When to use each one"],
    "procedure": ["Clear step-by-step process", "Numbered or sequential steps", "Conditions or prerequisites", "Expected outcome"],
}
DEFINITION_POINTS = ["Clear and concise explanation", "Essential characteristics", "Related concepts or context", "Applications or use cases"]
OTHER_POINTS = ["Comprehensive understanding", "Supporting details", "Relevant examples"]

WEAK_TOPIC_DEFAULT = ["DSA", "OS"]

PHRASE_STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]
