"""Texts labelled by hand for problem 4: a bounded sample that no model is fitted on. [kind|span] marks what a reader would replace."""

import re

MARKED = """
Please call [name|Maria Gonzalez] on [phone|+34 912 345 678] before noon.
Her new address is [address|14 Elm Street, Bristol], and the old flat is let.
Send the invoice to [email|accounts.dept@brightwater.example].
The build 20240311-1187 took 431 seconds on 10.20.30.40.
Passport [id_number|X4471902] was scanned twice.
My SSN is [id_number|512-44-9081], don't share it.
[name|Dr. Hannah Weiss] will join at ten.
Hannah left early; Mark stayed.
mark the page and paul it later.
Ask [name|Pedro Almeida] whether version 3.14.1592 is out.
He lives at [address|Lindenstraße 22, 10969 Berlin] since May.
Write to [email|jo dot smith at mail dot example dot org] or ring [phone|(212) 555-0188].
Ring [phone|020 7946 0991] or text [phone|07700 900 112].
Tax ID [id_number|44 809 112 733] belongs to the firm.
We counted 1,204,332 rows on 2021-08-14.
Ticket QZ-88213 is a duplicate of QZ-88201.
Install @scope/parser@4.2.1 and core@1.0.3 today.
Meet at noon. Dot the page.
Olga Systems shipped 12 units to Robert Street.
Thomas Foundry is a company, not a person.
Felix is only the code name of the project.
[name|MARTIN OKAFOR] signed the form.
Contact [name|Okafor, Martin] for access.
Dear [name|Mrs. Lindqvist], thank you.
Deliver to [address|P.O. Box 771, Leeds LS1 4AP] by Friday.
It took 12 minutes to drive; 3 close calls followed.
National insurance number [id_number|AB 12 34 56 C] is on file.
The driving licence [id_number|MORGA657054S9] expired.
From 2019-2021 we sold 4500 tiles.
Commit 4f9a1c2 changed 300 lines in 12 files.
Order 55-1029-88 arrived; serial 9931882.
Fax: [phone|+49 30 90182 4471].
[name|anna kowalska] said the hotline is [phone|1-800-555-0146].
The ratio was 0.7351 against 12.9 before.
Visit us at [address|Calle Mayor 18, Toledo] or at the station.
Reply to <[email|sven.larsen+list@post.example]> only.
Is [email|K.OLSEN@INBOX.TEST] still used?
Julia and Simon know the code.
Greta Park is closed on Mondays.
Session 1f02-8842-1190 was idle for 86400 seconds.
Call centre hours are 0900-1700.
Chapter 7 way forward and page 12 place holder.
[name|Jean Dupont] habite [address|7 rue de Rivoli, Paris].
Personal ID [id_number|740312-9987] was checked by [name|Emma Novak].
The 200 block row and 45 hill climbs.
User @karl mentioned @daniel/tools.
[name|Miguel Ferreira] and [name|Linda Petrov] met.
ISBN 9780131103627 is out of print.
Coordinates 51.5007, -0.1246 point to the bridge.
Room 12 on floor 3 is free.
Invoice 20230017 of 30.04.2023 is paid.
[name|Prof. Nakamura] speaks at [phone|+81 3 1234 5678].
Their office moved to [address|220 Harbour Road, Cork].
Key: value = a@b is a matrix product.
Adam optimiser with rate 0.001 converged in 12000 steps.
[name|Rosa Delgado]'s badge is lost.
Licence plate and licence terms are apart.
Phone support closes; phone 3 rings.
Server 192.0.2.44 answered port 8080 at 12:30:59.
""".strip().split("\n")


def parse(line: str) -> tuple[str, set[tuple[str, str]]]:
    """(text, {(kind, span)})"""
    return re.sub(r"\[\w+\|([^\]]*)\]", r"\1", line), {(k, s) for k, s in re.findall(r"\[(\w+)\|([^\]]*)\]", line)}


LABELLED = [parse(x) for x in MARKED]
#: Common English words for tests without a corpus.
COMMON = frozenset(
    "a an and are as at be before by call called for form from had has have he her his in is it its join joined know left list mark met my new not of off on only or "
    "out page said sent share she signed still stayed street that the their them they this to was we were who will with you early later today code name project "
    "company person stations optimiser rate speaks whether mentioned minutes drive closed access".split()
)
