import random
import re

import numpy as np
import pytest

from samewise.llm import p8_personal_data as P
from samewise.llm.p8_labelled import KINDS, labelled
from tests.conftest import rows

S = "doc_id long, text string, kind string, found string"

#: Written by hand, apart from the table: mentions in double braces.
SAMPLE = """Morning all, {{person:Harriet Oyelaran}} is back from leave and takes the on-call phone until Friday.
I left a voicemail for {{person:Dr. K|Konrad Vesely}} at {{phone:(415) 555-0136}}, no answer yet.
The lease still names {{address:18 Larkspur Crescent, Flat 2}}, Hereford as the mailing address.
Forward the invoice to {{email:accounts.payable@northgate-mills.example}} before the audit starts.
Two scans of the same form list SSN {{id_number:219-09-9999}} in plain text.
cc: {{person:Bettina Straub}}, {{person:Owen Maddox}}
Signed-off-by: {{person:Wiktor Zielonka}} <{{email:wiktor@zielonka.example.net}}>
Project Copper Heron moves to the archive after release Winter Lantern.
The Storage Team closed ticket 4471-20-1188 and reopened build 20240117.
{{person:Marisol Quintana-Rey}} asked whether the threshold should be 0.65 or 0.7.
Reach the night desk on {{phone:+44 20 7946 0018 ext. 4}} if the mirror stops.
sha256 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08 verified at 12:40:11
git@code.example.org:tools/scanner.git is the only remote left.
Passport number {{id_number:C4487012}} was visible in the second attachment.
My new address is {{address:77 Quarry Hill Road}}, Bristol.
Please write to {{email:maria dot lopes at sulfur dot example}} or {{email:maria.lopes (at) sulfur.example}}.
See docs/handoff-2024-03-12.md lines 120-188 for the merge log.
Regards,
{{person:Prudence Achterberg}}
| {{person:Lionel Abara}} | {{phone:020 7946 0991}} | {{email:l.abara@post.example}} |
Name: {{person:Sørensen, Maja}}
The second pass found 1,204 duplicate lines in 88 files.
Frau {{person:Gerlinde Hohenstein}} hat die Übergabe bestätigt.
Bitte Unterlagen an {{address:Lessingstraße 14b}}, 04109 Leipzig schicken.
Rückruf unter {{phone:030 4491772}} oder per Mail an {{email:g.hohenstein@kanzlei-beispiel.de}}.
Steuer-ID: {{id_number:86 095 742 719}}
Die Prüfung der Ordner Archiv und Entwurf dauerte 14 Minuten.
Freigegeben von {{person:Tobias Rademacher}} am Montag.
Projekt Blauer Anker ersetzt das Modul Sicherung.
Reisepass {{id_number:C01X0006H}} liegt als Kopie bei.
Laut {{person:Ottilie von Raben}} fehlt die letzte Zeile.
Merci à {{person:Solène Kerbrat}} pour la relecture du rapport.
Le colis est parti au {{address:5 bis, rue des Cordeliers}}, 35000 Rennes.
Appelez le {{phone:01 42 68 53 00}} avant midi.
N° de sécurité sociale {{id_number:2 85 05 78 006 084 36}}
Le projet Lanterne Rouge dépend du module Index.
Selon {{person:Théophile Marchand}}, la copie est complète.
Écrivez à {{email:contact@atelier-durance.fr}} en cas de doute.
La revisión la firmó {{person:Remedios Cañizares}} ayer por la tarde.
DNI {{id_number:45678912-K}}
Entregar en {{address:Calle de la Luna 21, 4.º C}}, Zaragoza.
Llame al {{phone:+34 976 123 456}} antes de las seis.
Gracias a {{person:Joaquín Belmonte Soler}} por los datos.
El equipo Puerto Claro cerró la versión 3.2.1 del módulo lector.
const owner = loadTable("entries", 42);
[08:15:02] INFO scanner files=418 skipped=7
"""
_MARK = re.compile(r"\{\{(\w+):(?:[^|{}]*\|)?([^{}]*)\}\}")


def sample():
    out = []
    for line in SAMPLE.replace("{{person:Dr. K|", "Dr. {{person:").splitlines():
        text, found, last = "", [], 0
        for m in _MARK.finditer(line):
            text += line[last : m.start()]
            found.append((len(text), len(text) + len(m[2]), m[1]))
            text, last = text + m[2], m.end()
        out.append((text + line[last:], found))
    return out


@pytest.fixture(scope="module")
def tagger():
    return P.trained()


def accuracy(tagger, held):
    truth = {(i, s, e, k) for i, (_, found) in enumerate(held) for s, e, k in found}
    got = {(i, s, e, k) for i, found in enumerate(P.tag(tagger, [t for t, _ in held])) for s, e, k in found}
    for kind in KINDS:
        a, b = {x for x in truth if x[3] == kind}, {x for x in got if x[3] == kind}
        yield kind, len(a), len(a & b) / len(a), len(a & b) / max(len(b), 1)


def test_accuracy_on_lines_written_by_hand(tagger):
    for kind, n, recall, precision in accuracy(tagger, sample()):
        assert n >= 5 and recall >= 0.7 and precision >= 0.8, (kind, recall, precision)


def test_held_out_accuracy(tagger):
    """Rows of the same grammar with other draws."""
    for kind, _, recall, precision in accuracy(tagger, labelled(1500, seed=77)):
        assert recall > 0.88 and precision > 0.9, kind


def test_weights_file_is_what_training_gives():
    """A small table: what is written and read again tags like the weights themselves."""
    lines = labelled(400, seed=3)
    made = P.train(lines, rounds=2)
    texts = [t for t, _ in labelled(200, seed=4)]
    a, b = P.tag(made, texts), P.tag(P.restore(P.dump(made)), texts)
    assert sum(x == y for x, y in zip(a, b, strict=True)) >= 190


def test_decoding_is_exact(tagger):
    """Leaving out stretches that can't gain gives the same labels as decoding whole lines."""
    texts = [t for t, _ in labelled(300, seed=5)]
    t = P.Tokens(texts)
    labels, score, bounds = tagger.decode(t), tagger.emissions(t), np.append(t.lines, len(t.starts))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        assert np.array_equal(P.viterbi(score[None, a:z], tagger.transitions, np.array([z - a]))[0], labels[a:z])


def test_viterbi_as_by_trying_all():
    from itertools import product

    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        score, trans = rng.normal(size=(1, n, 3)), rng.normal(size=(3, 3))
        value = lambda y: sum(score[0, i, y[i]] for i in range(len(y))) + sum(trans[a, b] for a, b in zip((0, *y), (*y, 0), strict=True))  # noqa: B023, E731
        best = max(product(range(3), repeat=n), key=value)
        assert tuple(P.viterbi(score, trans, np.array([n]))[0]) == best


def test_marginals_as_by_summing_all():
    from itertools import product

    rng = np.random.default_rng(1)
    score, trans = rng.normal(size=(1, 3, P.LABELS)), rng.normal(size=(P.LABELS, P.LABELS))
    prob, pairs = P._marginals(score, trans, np.array([3]))
    total, one = 0.0, np.zeros((3, P.LABELS))
    for y in product(range(P.LABELS), repeat=3):
        w = np.exp(sum(score[0, i, y[i]] for i in range(3)) + sum(trans[a, b] for a, b in zip((0, *y), (*y, 0), strict=True)))
        total += w
        for i in range(3):
            one[i, y[i]] += w
    assert np.allclose(prob[0], one / total) and np.isclose(pairs.sum(), 4)


def test_mentions_and_placeholders(spark):
    text = "Contact: ada.lind+x@mail.norbar.example\r\nPhone: +1 617 555 0184 ext. 12\nSSN: 666-20-8813\nAddress: 58 Umberholt Street, Unit 5, 00223 Verrano\ncc Edda Halrastrom"
    docs = [(1, text), (1, text), (2, None), (3, ""), (4, "nothing here\n" * 3), (None, text), (5, "x " * 50_000 + "\nPhone: 808-555-0161")]
    df = spark.createDataFrame([(*d, "k", "f") for d in docs], S)
    found = rows(P.mentions(df).where("doc_id = 1"), "kind", "found")
    assert ("email", "ada.lind+x@mail.norbar.example") in found and ("id_number", "666-20-8813") in found
    assert ("phone", "+1 617 555 0184 ext. 12") in found and ("person", "Edda Halrastrom") in found and len(found) == 5
    assert rows(P.mentions(df).where("doc_id = 5"), "found") == [("808-555-0161",)]
    out = {r["doc_id"]: r["text"] for r in P.redacted(df).collect()}
    assert set(out) == {1, 3, 4, 5} and out[4] == docs[4][1]
    assert out[1].startswith("Contact: [EMAIL]\r\nPhone: [PHONE]\nSSN: [ID_NUMBER]\nAddress: [ADDRESS], 00223 Verrano\ncc [PERSON]")


def test_placeholders_leave_all_else(tagger):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB1@. \n\t é\U0001f600-") for _ in range(200)) for _ in range(50)]
    for t, found in zip(texts, P.tag(tagger, texts), strict=True):
        last = 0
        for s, e, _ in found:
            assert last <= s < e <= len(t)
            last = e


def test_empty_table(spark):
    df = spark.createDataFrame([], S)
    assert P.mentions(df).count() == 0 and P.redacted(df).count() == 0
