"""The built-in lexicon for weak labels of Ukrainian comments."""

# --- Fixed values: words (found anywhere in the text) and patterns per label --
OBSCENE_PATTERNS = [
    r"\bбл.?ть",
    r"\bбл.?дь",
    r"\bбл.?д",
    r"\bбл.?т",
    r"\bжоп.?",
    r"\bж.?п.?",
    r"х.?й",
    r"х.?йня",
    r"х.?р",
    r"х.?є",
    r"х.?я.?",
    r"ху.?с.?с",
    r"приху.?ла",
    r"п.?зда",
    r"п.?зд",
    r"п.?здець",
    r"п.?здюк",
    r"с.{1,2}ка",
    r"сук",
    r"єб\s*",
    r"їб\s*",
    r"йоб\s*",
    r"н.?х",
    r"н.?х.?й",
    r"\bбл.?\b",
    r"\s.{1,2}бан\s*",
    r"\s.{1,2}бн\s*",
    r"к.?нчений",
    r"шл.?ха",
    r"шл.?хи",
    r"об.?сцян",
    r"\bсра\s+",
    r"хул.?",
    r"гівн?",
    r"3,14зд.?",
    r"др.?ч",
]

INSULT_WORDS = [
    "дурень",
    "дурак",
    "дура",
    "дурний",
    "придурок",
    "аутист",
    "ідіот",
    "ідіотка",
    "дебіл",
    "кретин",
    "мудак",
    "мудєнь",
    "погань",
    "мерзота",
    "мудак",
    "гівноїд",
    "криворук",
    "придурок",
    "тварина",
    "тварюка",
    "скотина",
    "скотинка",
    "скотин",
    "тупий",
    "тупа",
    "шляпа",
    "свиня",
    "коза",
    "козли",
    "козел",
    "змія",
    "півень",
    "страшний",
    "страшна",
    "покидьок",
    "грьобані",
    "ублюд",
    "чмо",
    "задрот",
    "шаболда",
    "виродки",
    "виродок",
    "потвора",
    "огидний",
    "гнида",
]
INSULT_PATTERNS = [
    r"ху.?с.?с",
    r"мраз.?",
    r"мудил.?",
    r"муділ.?",
    r"невдах.?",
]

THREAT_PATTERNS = [
    r"\bвб.ю\b",
    r"\bвбийся",
    r"\bвбити\b",
    r"\bздохни",
    r"\bздохнеш",
    r"\bпомреш",
    r"\bрозірву\b",
    r"\bприб.ю\b",
    r"\bзастрелю\b",
    r"\bзакопаю\b",
]

IDENTITY_WORDS = [
    "русіч",
    "рашист",
    "мужлан",
    "негр",
    "шльондр",
    "аутист",
]
IDENTITY_PATTERNS = [
    r"росіянц\s*",
    r"вкраїнч\s*",
    r"москов\s*",
    r"москал\s*",
    r"\bорк\s*",
    r"мацкал\s*",
    r"кацап\s*",
    r"хох.?л.?",
    r"\bжид.*",
    r"русн.*",
    r"т.?.?лк.?",
    r"тьолц.?",
    r"муслім.?",
    r"фемк.?",
    r"\bпід.?р",
]
# ------------------------------------------------------------------------------

UKRAINIAN = (
    [("obscene", "pattern", p) for p in OBSCENE_PATTERNS]
    + [("insult", "word", w) for w in INSULT_WORDS]
    + [("insult", "pattern", p) for p in INSULT_PATTERNS]
    + [("identity_hate", "word", w) for w in IDENTITY_WORDS]
    + [("identity_hate", "pattern", p) for p in IDENTITY_PATTERNS]
    + [("threat", "pattern", p) for p in THREAT_PATTERNS]
)
