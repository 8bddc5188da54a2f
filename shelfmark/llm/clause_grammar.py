"""Weighted transducers over the words of a clause, and their composition.

Five transducers each read one letter and write one letter per step: insults (letters of words that the
learned acceptor takes), threats (a trie of phrases), targets, negation and reported speech. Targets
may stand on either side of an insult, and a negation may close the clause behind it, so these two guess what
follows and accept only if the guess comes true: a clause has exactly one accepting path. The letters on
that path are its readings, the weight of a reading that of the insult's path in the acceptor.
"""

from dataclasses import dataclass, field

Arc = tuple[tuple, str, float]

# A negation or a reporting verb reaches this many words ahead within its clause; a negation
# that is the last word of a clause also reaches as many words back.
NEGATION_REACH = 4
REPORT_REACH = 12

# Closed word lists of the grammar (en, de, fr, es) ------------------
NEGATIONS = frozenset(
    "not never no isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás ningún".split()
)
REPORTS = frozenset(
    "said says wrote claimed alleged quoted called sagte sagt schrieb behauptete zitierte dit écrit affirmé cité dijo dice escribió "
    "afirmó citó".split()
)
TARGETS = frozenset("you your yourself they them he she du dich dir euch ihr sie tu toi vous te ils tú ti usted ustedes ellos".split())
THREATS = frozenset(
    "kill hurt murder destroy stab shoot burn töten umbringen ermorden zerstören tuer assassiner détruire matar asesinar destruir".split()
)
THREAT_PHRASES = (
    "end your life", "beat you up", "cut your throat", "slit your throat", "break your neck", "hunt you down", "blow you up",
    "wish you were dead", "make you suffer", "mach dich fertig", "mache dich fertig", "bring dich um", "bringe dich um",
    "schlag dich tot", "schlage dich tot", "te faire la peau", "te casser la gueule", "te trancher la gorge",
    "romperte la cara", "partirte la cara", "acabar contigo", "cortarte el cuello",
)
# ---------------------------------------------------------------------------------

# Letters: what a word is, and what the transducers make of an insult or threat.
OTHER, NEGATION, REPORT, TARGET, INSULT, THREAT = "other", "negation", "report", "target", "insult", "threat"
AIMED_INSULT, AIMED_THREAT, NEGATED, REPORTED = "aimed insult", "aimed threat", "negated", "reported"
LETTERS = (OTHER, NEGATION, REPORT, TARGET, INSULT, THREAT)
MATCHED = frozenset((INSULT, THREAT, AIMED_INSULT, AIMED_THREAT, NEGATED, REPORTED))


def letter_of(word: str) -> str:
    for words, letter in ((NEGATIONS, NEGATION), (REPORTS, REPORT), (TARGETS, TARGET)):
        if word in words:
            return letter
    return OTHER


@dataclass
class Transducer:
    """Arcs by (state, letter read): next state, letter written and weight, which multiplies along a path."""

    starts: frozenset = frozenset()
    finals: frozenset = frozenset()
    arcs: dict[tuple, list[Arc]] = field(default_factory=dict)

    def trimmed(self) -> "Transducer":
        """Without states from which no final one is reached: guesses that cannot come true."""
        before: dict = {}
        for (state, _), arcs in self.arcs.items():
            for after, _, _ in arcs:
                before.setdefault(after, set()).add(state)
        alive, open_ = set(self.finals), list(self.finals)
        while open_:
            for state in before.get(open_.pop(), ()):
                if state not in alive:
                    alive.add(state)
                    open_.append(state)
        arcs = {key: [a for a in found if a[0] in alive] for key, found in self.arcs.items() if key[0] in alive}
        return Transducer(self.starts & alive, self.finals, {key: found for key, found in arcs.items() if found})


def explore(starts, letters, step, final) -> Transducer:
    """The transducer of all states that ``step(state, letter)`` reaches."""
    found = Transducer(frozenset(starts))
    open_, seen = list(starts), set(starts)
    while open_:
        state = open_.pop()
        for letter in letters:
            arcs = list(step(state, letter))
            if arcs:
                found.arcs[state, letter] = arcs
            for after, _, _ in arcs:
                if after not in seen:
                    seen.add(after)
                    open_.append(after)
    found.finals = frozenset(s for s in seen if final(s))
    return found.trimmed()


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` makes of all that ``first`` writes."""

    def step(state, letter):
        left, right = state
        for after, written, weight in first.arcs.get((left, letter), ()):
            for then, last, more in second.arcs.get((right, written), ()):
                yield (after, then), last, weight * more

    letters = sorted({letter for _, letter in first.arcs})
    starts = [(a, b) for a in first.starts for b in second.starts]
    return explore(starts, letters, step, lambda s: s[0] in first.finals and s[1] in second.finals)


def threat_transducer() -> Transducer:
    """Writes a threat at the last word of a phrase, else what the word is. A state is the longest open beginning of a phrase."""
    phrases = {tuple(p.split()) for p in THREAT_PHRASES}
    begun = {p[:n] for p in phrases for n in range(len(p))}
    words = sorted({w for p in phrases for w in p})

    def step(state, letter):
        if letter == INSULT or letter == THREAT or letter not in words:
            return [((), letter, 1.0)]
        read = state + (letter,)
        written = THREAT if any(read[i:] in phrases for i in range(len(read))) else letter_of(letter)
        return [(next(read[i:] for i in range(len(read) + 1) if read[i:] in begun), written, 1.0)]

    return explore([()], [*LETTERS, *words], step, lambda s: True)


def target_transducer() -> Transducer:
    """Insults and threats of a clause with a target anywhere are aimed."""
    aimed = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}

    def step(state, letter):
        if state == "none":
            return [] if letter == TARGET else [("none", letter, 1.0)]
        return [("seen" if letter == TARGET else state, aimed.get(letter, letter), 1.0)]

    return explore(["none", "due"], LETTERS, step, lambda s: s != "due")


def negation_transducer() -> Transducer:
    """Insults and threats behind a negation within its reach, or before one that closes the clause, are negated.

    A state is (words that the last negation still reaches, words within which the clause must end with a negation,
    words within which it must not).
    """

    def step(state, letter):
        ahead, due, barred = state
        if due == 0:
            return  # the clause should have ended
        due = None if due is None else due - 1
        left = NEGATION_REACH if letter == NEGATION else max(0, ahead - 1)
        if letter in MATCHED and not ahead:
            yield (left, NEGATION_REACH if due is None else due, max(0, barred - 1)), NEGATED, 1.0
            yield (left, due, NEGATION_REACH + 1), letter, 1.0
        else:
            yield (left, due, max(0, barred - 1)), NEGATED if letter in MATCHED else letter, 1.0

    def final(state):
        ahead, due, barred = state
        closed = ahead == NEGATION_REACH  # the last word is a negation
        return not (closed and barred) if due is None else closed and not barred

    letters = [*LETTERS, AIMED_INSULT, AIMED_THREAT]
    return explore([(0, None, 0)], letters, step, final)


def report_transducer() -> Transducer:
    """Insults and threats behind a reporting verb within its reach are reported; a state is the words that it still reaches."""

    def step(ahead, letter):
        left = REPORT_REACH if letter == REPORT else max(0, ahead - 1)
        return [(left, REPORTED if ahead and letter in MATCHED else letter, 1.0)]

    return explore([0], [*LETTERS, AIMED_INSULT, AIMED_THREAT, NEGATED], step, lambda s: True)


@dataclass
class Grammar:
    """The composed grammar. ``context`` is composed whole; its states with those of the phrases are worked out as they are met,
    since nearly none of them ever is."""

    phrases: Transducer
    context: Transducer
    met: dict = field(default_factory=dict)

    def letter(self, word: str, is_insult: bool) -> str:
        if is_insult:
            return INSULT
        if word in THREATS:
            return THREAT
        return word if ((), word) in self.phrases.arcs else letter_of(word)

    def _arcs(self, state, letter) -> list[Arc]:
        found = self.met.get((state, letter))
        if found is None:
            left, right = state
            found = [
                ((after, then), last, weight * more)
                for after, written, weight in self.phrases.arcs[left, letter]
                for then, last, more in self.context.arcs.get((right, written), ())
            ]
            self.met[state, letter] = found
        return found

    def readings(self, words: list[tuple[str, float]]) -> list[tuple[str, float]]:
        """(letter, weight) of the insults and threats of a clause, given its words with the weights of insults (else 0)."""
        alive = {(a, b): None for a in self.phrases.starts for b in self.context.starts}
        for word, weight in words:
            letter, after = self.letter(word, weight > 0), {}
            for state, path in alive.items():
                for then, last, more in self._arcs(state, letter):
                    # One path only leads to a state from which the clause can be accepted.
                    after[then] = (path, last, (weight or 1.0) * more) if last in MATCHED else path
            alive = after
        out = []
        for (left, right), path in alive.items():
            if left in self.phrases.finals and right in self.context.finals:
                while path is not None:
                    path, last, weight = path
                    out.append((last, weight))
        return out[::-1]


def build_grammar() -> Grammar:
    return Grammar(threat_transducer(), compose(compose(target_transducer(), negation_transducer()), report_transducer()))
