"""Problem 10 on posts written by hand, put among posts of another kind: their wording stands neither in the code nor in the test tables."""

import os

import pytest

from lexiweave.llm.personal_data import personal_data

pytestmark = pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables here")
DATA = "/root/testdata/sf0.01/documents.parquet"
#: A post, and what it holds: kind and piece.
POSTS = [
    ("Could somebody forward this to Margaret Hollis? Her inbox is margaret.hollis@brightmail.com and she answers quickly.", [("name", "Margaret Hollis"), ("email", "margaret.hollis@brightmail.com")]),
    ("Lost: a grey cat near 14 Willow Crescent. If you spot her, ring 0161 496 0345 at any hour.", [("address", "14 Willow Crescent"), ("phone", "0161 496 0345")]),
    ("We had dinner with Daniel Okafor and Peter Lindqvist yesterday, great fun.", [("name", "Daniel Okafor"), ("name", "Peter Lindqvist")]),
    ("My social security number 078-05-1120 was printed on the form by mistake!", [("id_number", "078-05-1120")]),
    ("Passport number 533380006 has expired, says the officer.", [("id_number", "533380006")]),
    ("For invoices use billing@northgate-tools.co.uk or phone +44 20 7946 0018.", [("email", "billing@northgate-tools.co.uk"), ("phone", "+44 20 7946 0018")]),
    ("Dear Mrs. Helen Ashworth, your parcel is waiting at 221 Baker Street since noon.", [("name", "Helen Ashworth"), ("address", "221 Baker Street")]),
    ("Hi all, Thomas Grey here. Text me: (415) 555-2671.", [("name", "Thomas Grey"), ("phone", "(415) 555-2671")]),
    ("Our office moved to 9 Harcourt Road last spring; Laura Bennett has the keys.", [("address", "9 Harcourt Road"), ("name", "Laura Bennett")]),
    ("Ich heiße Jürgen Maler und wohne in der Gartenstraße 12. Telefon 030 901820.", [("name", "Jürgen Maler"), ("address", "Gartenstraße 12"), ("phone", "030 901820")]),
    ("Meine Ausweisnummer L01X00T47 steht auf der Rückseite.", [("id_number", "L01X00T47")]),
    ("Bonjour, je suis Camille Fournier. Mon adresse : 8 rue des Lilas. Portable 06 12 34 56 78.", [("name", "Camille Fournier"), ("address", "8 rue des Lilas"), ("phone", "06 12 34 56 78")]),
    ("Hola, soy Elena Navarro, mi DNI es 12345678Z y vivo en Calle Mayor 45.", [("name", "Elena Navarro"), ("id_number", "12345678Z"), ("address", "Calle Mayor 45")]),
    ("Buongiorno, mi chiamo Marco Bellini, abito in Via Garibaldi 7, cellulare 347 123 4567.", [("name", "Marco Bellini"), ("address", "Via Garibaldi 7"), ("phone", "347 123 4567")]),
    ("Send the cheque to Robert Haines, 77 Station Road, before Monday.", [("name", "Robert Haines"), ("address", "77 Station Road")]),
    ("jessica_m.stone (at) quickpost (dot) org is where I can be found", [("email", "jessica_m.stone (at) quickpost (dot) org")]),
    ("Sincerely,\nEdward Pemberton", [("name", "Edward Pemberton")]),
    ("The coach, William Thatcher, can be called on 0207 946 0999 after practice.", [("name", "William Thatcher"), ("phone", "0207 946 0999")]),
    ("National insurance: AB 12 34 56 C, please keep it private.", [("id_number", "AB 12 34 56 C")]),
    ("Has anyone talked with Susan Whitfield lately? She used to write from swhitfield77@gmail.com", [("name", "Susan Whitfield"), ("email", "swhitfield77@gmail.com")]),
    ("Come over to 3 Orchard Close on Sunday, bring cake.", [("address", "3 Orchard Close")]),
    ("Reservations under Nathalie Dubois, +33 1 70 18 99 00.", [("name", "Nathalie Dubois"), ("phone", "+33 1 70 18 99 00")]),
    ("Mr. Brian Colworth lives at 58 Kings Avenue and never picks up (0113 496 0122).", [("name", "Brian Colworth"), ("address", "58 Kings Avenue"), ("phone", "0113 496 0122")]),
    ("Driving licence no. D1234567 found in the car park.", [("id_number", "D1234567")]),
    ("Contact: Karen Albright, karen@albright.io, 212-555-0187", [("name", "Karen Albright"), ("email", "karen@albright.io"), ("phone", "212-555-0187")]),
    ("Michael J. Foster wrote:\n> I disagree completely.", [("name", "Michael J. Foster")]),
    ("Prof. Ingrid Solberg gave the talk; slides via ingrid.solberg@uni-nord.no", [("name", "Ingrid Solberg"), ("email", "ingrid.solberg@uni-nord.no")]),
    ("Deliver the piano to 1450 Lakeview Drive, ask for Steven Marsh.", [("address", "1450 Lakeview Drive"), ("name", "Steven Marsh")]),
    ("My cell is 646-555-0143, email d.wexler@fastmail.net, yours?", [("phone", "646-555-0143"), ("email", "d.wexler@fastmail.net")]),
    ("I met Olivia Hartman at the station, she said hello.", [("name", "Olivia Hartman")]),
    ("NIE X-1234567-L belongs to my wife, Sofía Romero.", [("id_number", "X-1234567-L"), ("name", "Sofía Romero")]),
    ("Mein Name ist Sabine Vogel, schreibt mir an sabine.vogel@posteo.de", [("name", "Sabine Vogel"), ("email", "sabine.vogel@posteo.de")]),
    ("Treffen wir uns im Lindenweg 5? Handy: 0171 3920456", [("address", "Lindenweg 5"), ("phone", "0171 3920456")]),
    ("Yours,\nVictoria Langley\n16 Mill Lane", [("name", "Victoria Langley"), ("address", "16 Mill Lane")]),
    ("SSN 219-09-9999 on file for Andrew Kessler", [("id_number", "219-09-9999"), ("name", "Andrew Kessler")]),
    ("Please ring +49 89 636 48018 or fax 089 63648018.", [("phone", "+49 89 636 48018"), ("phone", "089 63648018")]),
    ("Mon passeport 12AB34567 est resté chez Philippe Marchand.", [("id_number", "12AB34567"), ("name", "Philippe Marchand")]),
    ("Thanks go to Alice Thornbury and George Penrose for moderating.", [("name", "Alice Thornbury"), ("name", "George Penrose")]),
    ("support@kite-and-co.com keeps bouncing, try help@kite-and-co.com instead", [("email", "support@kite-and-co.com"), ("email", "help@kite-and-co.com")]),
    ("The flat at 402 Elm Terrace is free again, call Frank Doyle (0131 496 0777).", [("address", "402 Elm Terrace"), ("name", "Frank Doyle"), ("phone", "0131 496 0777")]),
    ("Identity card 987654321 was handed in at the desk.", [("id_number", "987654321")]),
    ("Llámame al 612 345 678 o escribe a pablo.ruiz@correo.es", [("phone", "612 345 678"), ("email", "pablo.ruiz@correo.es")]),
    ("His sister Rachel Norwood teaches maths.", [("name", "Rachel Norwood")]),
    ("J'habite 27 avenue Foch, et vous ?", [("address", "27 avenue Foch")]),
    ("Visit us: 88 Quarry Hill. Ask Julia Brandt or mail julia at brandt dot de", [("address", "88 Quarry Hill"), ("name", "Julia Brandt"), ("email", "julia at brandt dot de")]),
    ("Passport no: K8729014, issued to Martin Ellery", [("id_number", "K8729014"), ("name", "Martin Ellery")]),
    ("Anyone know whether Hannah Crowe still lives at 31 Beacon Street?", [("name", "Hannah Crowe"), ("address", "31 Beacon Street")]),
    ("WhatsApp me on +1 312 555 0190", [("phone", "+1 312 555 0190")]),
    ("The social security no. is 457-55-5462, do not share", [("id_number", "457-55-5462")]),
    ("His NI number reads JG 10 37 59 A, I copied it myself", [("id_number", "JG 10 37 59 A")]),
    ("tax id 123-45-6789 of Simon Prescott", [("id_number", "123-45-6789"), ("name", "Simon Prescott")]),
]
#: Posts without personal data.
PLAIN = [
    "The year 2019 was fine, 3 points on the board and 12 people in line.", "See page 41 of chapter 7, version 2.10.4 has it.", "New York and Lake Geneva are far from here.", "We meet @ noon, at the Old Town Hall.", "Order 88321-009 shipped on Tuesday March 4.",
    "Item 4711-0815 costs $129.99 at the market.", "Happy New Year to the Red Lions Football Club!", "10 years ago this road had 5 lanes.", "Invoice 20231107 is paid.", "ISBN 978-3-16-148410-0 is a nice book.",
]


@pytest.fixture(scope="module")
def outcome(spark):
    mine = [(10**9 + k, t) for k, (t, _) in enumerate(POSTS)] + [(2 * 10**9 + k, t) for k, t in enumerate(PLAIN)]
    others = spark.read.parquet(DATA).select("doc_id", "text")
    docs = others.unionByName(spark.createDataFrame(mine, "doc_id long, text string"))
    return {tuple(r) for r in personal_data(docs).where("doc_id >= 1000000000").collect()}


@pytest.mark.parametrize("kind", ["email", "phone", "id_number", "address", "name"])
def test_recall_of_each_kind(outcome, kind):
    want = {(10**9 + k, kind, x) for k, (_, found) in enumerate(POSTS) for y, x in found if y == kind}
    assert sum(len(found) for _, found in POSTS) >= 90
    assert len(want & outcome) >= 0.9 * len(want), sorted(want - outcome)


def test_little_else_is_found(outcome):
    want = {(10**9 + k, y, x) for k, (_, found) in enumerate(POSTS) for y, x in found}
    assert len(outcome - want) <= 0.1 * len(want), sorted(outcome - want)
