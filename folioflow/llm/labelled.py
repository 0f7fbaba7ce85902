"""The small labelled table that the personal-information model is trained on.

Each row is a line of a note with its mentions marked as ``{type}``. The lines are written for
this purpose and taken from no corpus; the marks are filled with invented values of many
written forms (``fill``), and in part of the rows ordinary words give way to invented ones, so
the model learns forms and surroundings and neither names nor sentences.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

# Field names of forms and letters, by what follows them.
FIELDS = {
    "title_name": "Patient|Patient name|Patient Name|Name|Full name|Name of patient|Pt|Client|Resident|Next of kin|Guardian|Emergency contact|Father's name|Spouse|Informant|"
    "Paciente|Nombre|Nombre y apellidos|Nombre del paciente|Familiar|Acompañante|Nome|Nome completo|Nome do paciente|Responsável|Acompanhante|"
    "Patientin|Name, Vorname|Name des Patienten|Angehörige|Begleitperson|Nom|Nom et prénom|Nom du patient|Nom de la patiente|Personne de confiance|"
    "Naam|Mareez|Mareez ka naam|Rogi ka naam|Pita ka naam|Pati ka naam|नाम|मरीज का नाम|रोगी का नाम|रोगी|पिता का नाम|पति का नाम",
    "doctor": "Doctor|Consultant|Physician|Surgeon|Referred by|Attending|Seen by|Signed|Médico|Médica|Tratante|Cirujano|Cirurgião|Arzt|Ärztin|Hausarzt|Behandelnder Arzt|Operateur|"
    "Médecin|Chirurgien|Médecin traitant|Doctor ka naam|Chikitsak|Daktar|डॉक्टर|चिकित्सक|सर्जन",
    "id": "ID|Hospital no|File no|Record number|Case no|Registration no|MRN|UHID|NHS no|Insurance no|Policy no|Passport|Aadhaar|Admission no|Admission number|Card|"
    "Historia|Historia clínica|N.º de historia|DNI|Póliza|Expediente|N.º de ingreso|Prontuário|CPF|Apólice|Cartão|N.º de internação|"
    "Patientennummer|Fallnummer|Aufnahmenummer|Versicherungsnummer|Ausweis|Dossier|N° de dossier|N° d'admission|Numéro de sécurité sociale|Carte|Police|"
    "Panjikaran|Panjikaran sankhya|Bharti sankhya|Card sankhya|पंजीकरण|पंजीकरण संख्या|भर्ती संख्या|कार्ड संख्या",
    "address": "Address|Home address|Residence|Permanent address|Lives at|Domicilio|Dirección|Vive en|Endereço|Residência|Mora em|Adresse|Anschrift|Wohnort|Wohnhaft|Domicile|Pata|Ghar ka pata|पता|घर का पता",
    "phone": "Phone|Tel|Mobile|Contact|Contact no|Telephone|Cell|Teléfono|Tel.|Móvil|Contacto|Telefone|Celular|Contato|Telefon|Handy|Kontakt|Rückruf|Téléphone|Portable|Contact|Phone number|Sampark|Mobile number|फोन|मोबाइल|संपर्क",
    "email": "Email|E-mail|Mail|Contact|Correo|Correo electrónico|Contacto|E-mail|Contato|E-Mail|Kontakt|Courriel|Mail|Contact|Email|Sampark|ईमेल|संपर्क",
    "other": "Age|Age/Sex|Ward|Bed|Date|Weight|BP|Pulse|Allergies|Diagnosis|Edad|Edad/Sexo|Sala|Cama|Fecha|Idade|Idade/Sexo|Leito|Data|Alter|Alter/Geschlecht|Station|Bett|Datum|Âge|Âge/Sexe|Lit|Umar|Umar/Ling|Tareekh|आयु|आयु/लिंग|तारीख",
}
TITLES = "Mr.|Mrs.|Ms.|Miss|Mr|Mrs|Sr.|Sra.|Srta.|Don|Doña|Dona|Herr|Herrn|Frau|M.|Mme|Mlle|Monsieur|Madame|Shri|Smt.|Kumari|श्री|श्रीमती|कुमारी"
KIN = (
    "His brother|Her brother|His sister|Her sister|The mother|His mother|Her father|The son|Her son|The daughter|His daughter|His cousin|Her nephew|The niece|Her grandson|The widow|"
    "Su hermano|Su hermana|Su madre|El padre|Su hijo|La hija|Su primo|La sobrina|El nieto|O irmão|A irmã|A mãe|O pai|O filho|A filha|O primo|A sobrinha|O neto|"
    "Der Bruder|Die Schwester|Die Mutter|Der Vater|Der Sohn|Die Tochter|Der Vetter|Die Nichte|Son frère|Sa soeur|La mère|Son père|Le fils|Sa fille|Son cousin|La nièce|"
    "Unke bhai|Unki behen|Unki maa|Unke pita|Unka beta|Unki beti|Uska bhai|उनके भाई|उनकी बहन|उनकी माँ|उनके पिता|उनका बेटा|उनकी बेटी|चाचा|मामा"
)
_HINDI_KIN = "उनके भाई|उनकी बहन|उनकी माँ|उनके पिता|उनका बेटा|उनकी बेटी|चाचा|मामा".split("|")
FACILITIES = "Hospital|Memorial Hospital|Clinic|Nursing Home|Institute|Medical Centre|Dispensary|Infirmary|Polyclinic|Health Centre|Eye Centre|Care Home|Laboratory|Medical College"
DOCTORS = "Dr.|Dr.|Dr.|Dr|Dra.|Prof.|Prof. Dr.|डॉ.|डॉ"

# Labelled lines. {name} {lower} {email} {phone} {id} {address} are mentions; {title} and {doctor} are titles, what else is in braces is none.
LINES = """
{title} {name} came to the desk at noon.
The ward clerk spoke to {title} {name} about the transfer.
We met {title} {name} and explained the plan.
Handed over to {doctor} {name} at eight.
The films were shown to {doctor} {name}, who agreed.
{doctor} {name} operated without delay.
Discussed with {doctor} {name} before noon.
Reviewed by {doctor} {name} and {doctor} {name}.
{name} agreed to the operation.
{name} refused the injection and went home.
{name}, a retired {word}, slept badly.
{name} was told about the risks. {sentence}
{lower} was told about the risks. {sentence}
{lower} agreed to the operation and went home.
{lower} has taken {drug} since {n}.
{sentence} {lower} understood the advice.
{sentence} {lower}'s uncle waited outside.
{name}'s uncle waited outside.
{sentence} {name}'s aunt brought the old films.
{sentence} {name} and her niece {name} were both warned.
The daughter, {name}, keeps the diary.
A neighbour named {name} called the ambulance.
His wife {name} found him on the floor.
Her husband {lower} found her on the floor.
The interpreter was {name}. {sentence}
{sentence} The letter was typed for {name} of {address}.
{sentence} {title} {name} moved from {address} to {address} last year.
{sentence} An ambulance went to {address} before dawn.
She resides at {address} and cooks for herself.
Parcels for the family go to {address}.
{sentence} Deliver the walking frame to {address}, as agreed with {name}.
The insurer holds number {id} for this family.
{sentence} Quote {id} in every letter.
{sentence} The wristband showed {id} instead of {id}.
Passport {id} was copied at the desk.
The sample carried the label {id}. {sentence}
Telephone {phone} in an emergency.
{sentence} Leave a message at {phone} after six.
{name} answers under {phone} in the evening.
{sentence} The son ({name}, {phone}) will fetch him.
Results go to {email}, not by post.
{sentence} {name} prefers {email} for appointments.
Send the scans to {email} and phone {phone}.
{title} {name} wants news by mail at {email} or by phone under {phone}.
Por favor llame al {phone} si hay dudas.
{sentence} Atendida por {doctor} {name} en urgencias.
{title} {name} acudió con su esposo {name}.
La señora {name} firma la hoja y se marcha a {address}.
{sentence} Su nieto {lower} trae las recetas.
Reside en {address} desde la infancia.
El volante se mandó al correo {email}.
{sentence} Tarjeta sanitaria {id}, comprobada en admisión.
Avisar a {name}, teléfono {phone}.
{name} vino sola y entendió el plan.
Favor ligar para {phone} em caso de dúvida.
{sentence} Avaliada por {doctor} {name} no plantão.
{title} {name} veio com a irmã {name}.
A senhora {name} voltou para casa, em {address}.
{sentence} O neto {lower} traz as receitas.
Reside em {address} desde criança.
O pedido seguiu pelo e-mail {email}.
{sentence} Cartão número {id}, visto na recepção.
Avisar {name}, telefone {phone}.
{name} veio só e entendeu o plano.
Bitte bei Fragen {phone} anrufen.
{sentence} Vorgestellt bei {doctor} {name} in der Ambulanz.
{title} {name} erschien mit dem Ehemann {name}.
Die Nachbarin {name} rief den Notarzt.
{sentence} Der Enkel {lower} bringt die Rezepte.
Sie zog nach {address} um.
{title} {name} lebt in {address} bei der Schwester.
Den Brief bitte an {email} schicken.
{sentence} Die Karte mit der Nummer {id} lag vor.
Zu verständigen: {name}, Telefon {phone}.
{name} kam allein und verstand den Plan.
En cas de doute, appeler le {phone}.
{sentence} Vue par {doctor} {name} aux urgences.
{title} {name} est venue avec son mari {name}.
La voisine {name} a prévenu les secours.
{sentence} Le petit-fils {lower} apporte les ordonnances.
Elle a déménagé au {address} au printemps.
{title} {name} loge au {address} chez sa soeur.
Merci d'écrire à {email} pour la suite.
{sentence} La mutuelle porte le numéro {id} sur la feuille.
Prévenir {name}, téléphone {phone}.
{name} est venue seule et a compris.
{sentence} {title} {name} apni beti {name} ke saath aaye.
{name} ne operation ke liye haan kaha.
{lower} ne operation ke liye haan kaha.
{sentence} Padosi {name} ne ambulance bulayi.
{sentence} Beta {lower} dawai laata hai, phone {phone}.
Ghar {address} par hai.
{title} {name} ab {address} mein hain.
Parcha {email} pe mail karna hai.
{sentence} Beema number {id} likha hua tha.
Zaroorat ho to {phone} par phone karein.
{doctor} {name} ne subah dekha.
{sentence} {title} {name} अपनी बेटी {name} के साथ आए।
{name} ने ऑपरेशन के लिए हाँ कहा।
पड़ोसी {name} ने एम्बुलेंस बुलाई। {sentence}
जरूरत हो तो {phone} पर फोन करें।
घर {address} पर है। {sentence}
{title} {name} अब {address} में रहते हैं।
पर्चा {email} पर मेल करना है।
बीमा नंबर {id} लिखा हुआ था। {sentence}
{doctor} {name} ने सुबह देखा।
"""

# Labelled lines of invented words only, which leave nothing but form and place to go by.
LOOSE = """
{kin} {name} {word} {word} {phone}.
{kin} {name} {word} {word} {word} {phone} {word}.
{sentence} {kin} {name} {word} {phone} {word}.
{sentence} {kin} {lower} {word} {word} {word}. {sentence}
{kin} {lower} {word} {word} {phone}.
{kin} {name}, {word} {word} {address}, {word} {word}.
{title} {name} {word} {word} {word}.
{title} {lower} {word} {word} {address} {word}.
{sentence} {title} {name} {word} {word} {address} {word}.
{sentence} A {title} {name} {word} {word} {address} {word} {word}.
{sentence} La {title} {name} {word} {word} {address} {word} {word}.
{sentence} {title} {name} {word} {word} {word} {word} {email} {word} {word} {phone}.
{Word} {word} {name}, {word} {word} {word} {address}, {word} {noun} {word}.
{sentence} {doctor} {name} {word} {word} {word}. {sentence}
{Word} {word} {word} {doctor} {name} {word} {word} {word}.
{word} {word} {name} {word} {word} {word}.
{Word} {word} {name} {word}, {word} {word}.
{Word} {word} {title} {name} {word} {word}.
{name} {word} {word} {word} {word}.
{sentence} {name} {word} {word} {word}.
{sentence} {Word} {word} {word} {lower} {word} {word} {word}.
{sentence} {Word} {word} {name}, {word} {word} {address}, {word} {word}.
{Word} {word} {address} {word} {word}.
{Word} {address} {word} {word} {word}.
{word} {word} {word}: {address}
{Word} {word} {word} {address} {word} {word} {id}.
{Word} {word} {id} {word}.
{sentence} {Word} {word} {word} {id} {word} {word}. {sentence}
{Word} {word} {word} {word} {id}.
{Word} {word} {phone} {word} {word} {word}.
{sentence} {Word} {name} {word} {word} {phone}.
{Word} {word} {word} {phone}. {sentence}
{Word} {email} {word} {word}.
{sentence} {Word} {word} {word} {email} {word} {phone}.
{Word} {word} {word} {email}. {sentence}
{word} {word} {id} {word} {word}.
{sentence} {Word} {word} {id} {word} {word}.
{Word} {noun} {id} {word} {word}. {sentence}
{Word} {word} {phone} {word}. {sentence}
{sentence} {Word} {word} {word} {phone} {word} {word} {word}.
{Word} {noun} {name} {word} {word} {phone} {word}.
{sentence} {Word} {email} {word} {word}. {sentence}
{deva} {deva} {email} {deva} {deva}।
{deva} {deva} {id} {deva} {deva}।
{deva} {deva} {name} {deva} {phone} {deva} {deva} {deva}।
{deva} {deva} {deva} {address} {deva}।
{sentence} {deva} {name} {deva} {deva}।
{hkin} {name} {deva} {phone} {deva} {deva} {deva} {deva}।
{sentence} {hkin} {name} {deva} {phone} {deva} {deva}।
{deva} {deva} {deva}: {name}
{deva} {deva}: {hdoctor} {name}
{deva}: {hdoctor} {name}
{deva} {deva}: {htitle} {name}
{sentence} {htitle} {name} {deva} {deva} {deva}।
{word} {word}: {name}
{Word} {word}: {title} {name}
{Word}: {doctor} {name}
{Word} {word} : {name}
"""

# Lines and sentences without any mention. {drug} {word} {noun} are invented words, {cap} invented proper names, {n} numbers.
PLAIN = """
{cap} General Hospital
{cap} Eye Hospital
{cap} Heart Institute
{cap} Nursing College
{cap} Day Surgery Centre
Saint {cap} Hospital
St. {cap} {cap} {facility}
St. {cap}'s {facility}
The ambulance left St. {cap} {facility} at {n2}:{n2}.
Notes from St. {cap} {facility} were lost.
{ABC} and {ABC} were {word}.
{ABC}: {n}/{n}, {n}/{n}, {n}.
{ABC} {word}: {n}.{n} {word}.
{Word}: {ABC} {word} {word} {word}.
{sentence} {ABC} {word} was {word}, {ABC} {n}.
{Word} {word} {ABC}-{n5} {word} at {n2}:{n2}.
{Word} {ABC}-{n5} {word} {word} {word}.
{cap} {facility}, {word} {word}
St. {cap} {facility}, {word} {word} {n}
{Word} {word} {word} St. {cap} {facility} {word} {word}.
{ABC} showed {word} {word}.
{ABC} of the {word} was {word}; {ABC} was not {word}.
{ABC}-{n} {word} and {ABC} {n} {word}.
Das {noun} {word} keinen {word} {noun}, und die {noun} {word} {word}.
Das {noun} blieb {word}.
Ein {noun} {word} am {n2}.{n2}. {word}.
Eine {noun} war nicht {word}.
Es {word} sich {word} {noun}.
Nach {noun} und {noun} {word} er {word}.
Im {noun} {word} sich {noun} ohne {noun}.
Mit {noun} wurde {word}, dass {noun} {word}.
Am {noun} {word} {word} {noun}.
{deva}-{deva} {deva} {deva} {deva}।
दो {deva} {deva} {deva} {deva} {deva}।
{noun}: {deva} {deva} {deva} {deva} {deva}।
{deva}: {deva} {deva} {deva} {deva} {n} {deva}।
St. {cap} Dispensary
St. {cap} {facility}
{cap} {facility}
{cap} {cap} {facility}
{cap} Clinic and Laboratory
Hospital {cap}
Clínica {cap}
Hospital de {cap}
Klinikum {cap}
Klinik am {cap}
Hôpital {cap}
Clinique {cap}
Progress Note
Operation Note
Ward Letter
Nota de ingreso
Carta de alta
Carta de referência
Arztbrief
Verlaufsbericht
Lettre de liaison
Bharti parcha
भर्ती पर्चा
A {word} {word} {word} with {word}.
Sent on to St. {cap} {facility} for {word}.
Her {word} {word} was {word} for {n} days.
Her {word}-{word} {word} {word} the {word} {word}.
His {word} {word} {word} and {word}.
Their {word} {word} {word}.
Su {word} {word} {word} desde {word}.
Sa {word} {word} {word} depuis {word}.
Unki {word} {word} {word} hai.
उनका {deva} {deva} था।
{deva} {deva} {deva} {deva} और {deva} {deva} {deva}।
Wegen {noun} {word} er {n} {noun} {word} {word}.
Bei {noun} {word} {word} die {noun} {word}.
{Word} {word}, although C-{word} {word} had {word}.
C-{word} {word} was {word} at {n}.{n}.
X-{word} of the {word} showed {word} {word}.
{Word} {word} à {n} h {n} par le {word}.
A {word}-{word} {word} came to {word} with {word}.
A {word} {word} {word} {word} {word} {word}.
O {word} {word} {word} {word} em {word}.
O {word} também {word} {word} e {word} há {n} dias.
E {word} {word} {word}, {word} {word}.
L'{word} {word} ne {word} pas de {word}.
L'{word} d'{word} {word} l'{word}.
L'{word} était {word} et d'{word} {word}.
D'{word} {word}, l'{word} n'{word} pas {word}.
C'{word} {word} qu'{word} {word} s'{word}.
J'{word} {word} une {word} {word}.
{Word} : L'{word} {word} {word} {word}.
{Word}-{word} {word} was {word} at {n}.{n}.
{Word}-{word} {word} {word}, {word} {word}.
{Word} {word} was under {word} {word} in {word}.
{Word} {word}-{word} {word} with {word} {word}.
{Word} {word} {Word}, {word} the {word} {word}.
{Word} {n}{Word} and B{n} were {word}.
T{n}DM, C{n}, L{n}-L{n} and H{n}N{n} were {word}.
Model {cap}-{n5} {word} at {n2}:{n2}.
{Word} model XR-{n5} {word} {word} at {n2}:{n2}.
{cap} disease had been named once before.
{cap} reflex present, {cap} test negative.
The {cap} scale gave {n} and the {cap} index {n}.
A {cap} drain stayed in for {n} days.
Stage {n} after {cap} and {cap}.
The {cap} triad was complete.
He came over from {cap} Hospital by bus.
She trained at the {cap} Institute for years.
Transferred out of St. {cap} Dispensary at night.
The {cap} trial had {n} centres.
Monitor type {cap}-{n} failed.
Serial {cap} {n5}/{n2} replaced.
Batch {n5}/{n2} expired on {n2}-{n2}-2027.
White cells fell from {n6} to {n7} a microlitre.
Readings {n}/{n}, {n}/{n} and {n}/{n} at rest.
Dose: {n} mg @ 8, @ 14 and @ 20 h.
Room {n}, bed {n}, floor {n}.
See page {n} of {word}.{word}.example/{word} for the table.
Sodium {n}.{n}, potassium {n}.{n}, urea {n}.
Dated {n2}/{n2}/2026 and {n2}.{n2}.2027.
{drug} {n} mg was given at night.
{Drug} {n} mg was given at night.
{Drug} {n}.5 mg and {drug} {n} mcg were stopped.
Take {drug} {n} mg with food, then rest.
{Word} {word} was seen on both sides.
{Word} of the {word} was small and {word}.
The {word} {word} was {word} after {n} days of {drug}.
After {word}, the {word} nurse gave {drug} to a young {word}.
He had {word} and {word} without {word}, so {drug} was held.
She denied {word}, {word} or {word}.
An old {word} was brought in with {word} {word}.
A tall {word} woman had {word} for {n} weeks.
Was it {word}, or only {word} {word}?
Of {n} patients, {n} had {word}; {n} percent took {drug}.
Between {n} and {n} months, {word} rose by {n}.{n} units.
The second reader marked {n} of {n} sheets as {word}.
The night porter moved the {word} and rang for help.
The family asked whether {word} could wait.
Plan: {word} diet, {word} twice a week, and {drug} {n} mg.
Findings: {Word} {word} with {word}.
Summary: The {word} was {word}. {Drug} was tried.
History: {Word} for {n} days. No {word}.
Vitamin K and factor VIII were normal; CRP {n}, TSH {n}.{n}.
No change on MRI of the {word} or at C5-C6.
In March the {word} was {word} and in April it was not.
On Monday the {word} team met the dietician.
Breathing was {word}, speech was {word}, gait was {word}.
El dolor era {word} y la {word} estaba bien.
La {word} del {word} fue de {n} con {n}.
Tomó {drug} {n} mg cada noche por {word}.
No hubo {word} ni {word} en las últimas {n} horas.
Antecedentes: {Word} desde hace {n} años. La {word} era leve.
Plan: Se pide {word} y se repite la {word} en {n} días.
La enfermera de noche revisó la hoja y llamó al servicio.
Hace tres días empezó con {word} y {word} en la pierna.
A dor era {word} e a {word} estava bem.
A {word} do {word} foi de {n} por {n}.
Tomou {drug} {n} mg toda noite por {word}.
Não houve {word} nem {word} nas últimas {n} horas.
Antecedentes: {Word} há {n} anos. A {word} era leve.
Conduta: Pede-se {word} e repete-se a {word} em {n} dias.
A enfermeira da noite viu a folha e chamou a equipe.
Há três dias começou com {word} e {word} na perna.
Der {noun} war {word} und die {noun} unauffällig.
Die {noun} des {noun} betrug {n} zu {n}.
Er nahm jeden Abend {drug} {n} mg gegen {noun}.
Kein {noun}, keine {noun} in den letzten {n} Stunden.
Vorgeschichte: {noun} seit {n} Jahren, {noun} gering.
Plan: {noun} abwarten und {noun} in {n} Tagen wiederholen.
Die Nachtschwester prüfte den Bogen und rief den Dienst.
Vor drei Tagen begannen {noun} und {noun} im Bein, daher {drug}.
Unter {drug} ging die {noun} zurück, sodass {noun} und {noun} möglich waren.
Beim {noun} fiel ein {word} {noun} auf.
La douleur était {word} et la {word} normale.
La {word} du {word} était de {n} sur {n}.
Il prenait {drug} {n} mg chaque soir contre la {word}.
Pas de {word} ni de {word} depuis {n} heures.
Antécédents : {Word} depuis {n} ans. La {word} était modérée.
Projet : Une {word} est demandée et la {word} sera refaite dans {n} jours.
L'infirmière de nuit a relu la feuille et appelé l'équipe.
Depuis trois jours, {word} et {word} de la jambe.
Dard {word} tha aur {word} theek thi.
{Word} ki {word} {n} se {n} thi.
Raat ko {drug} {n} mg liya, {word} ke liye.
Pichhle {n} ghante mein na {word} thi na {word}.
Salah: {Word} karwana hai aur {n} din baad aana hai.
Nurse ne raat ko chart dekha aur team ko bulaya.
Teen din se pair mein {word} aur {word} hai.
Kal subah se bukhar kam hai aur bhookh lagti hai.
दर्द हल्का था और भूख ठीक थी।
रात को दवा ली और नींद आ गई।
पिछले {n} घंटे में न उल्टी थी न बुखार।
सलाह: आराम करें और {n} दिन बाद आएँ।
नर्स ने रात को चार्ट देखा और टीम को बुलाया।
तीन दिन से पैर में सूजन और जलन है।
कल सुबह से साँस ठीक है और वजन {n} किलो है।
"""

_ONSET = "b d f g k l m n p r s t v z br dr gr kr st sh th tr vl zh ch qu w h j y".split()
_NUCLEUS = "a e i o u a e i o ia ee au".split()
_CODA = " n r l s th nd rt m ck sh v x".split(" ")
_DEVA = "क ख ग घ च ज त थ द ध न प फ ब भ म य र ल व श ष स ह".split()
_MATRA = ["", "ा", "ि", "ी", "ु", "ू", "े", "ै", "ो", "ौ"]
_DEVA_DIGITS = str.maketrans("0123456789", "०१२३४५६७८९")


def _word(r: random.Random, low: int = 2, high: int = 3) -> str:
    return "".join(r.choice(_ONSET) + r.choice(_NUCLEUS) + (r.choice(_CODA) if r.random() < 0.4 else "") for _ in range(r.randint(low, high)))


def _cap(r: random.Random) -> str:
    return _word(r).capitalize()


def _name(r: random.Random, deva: float = 0.05) -> str:
    if r.random() < deva:
        part = lambda: "".join(r.choice(_DEVA) + r.choice(_MATRA) + ("्" + r.choice(_DEVA) if r.random() < 0.2 else "") for _ in range(r.randint(2, 4)))
        return f"{part()} {part()}"
    first, last = _cap(r), _cap(r)
    if r.random() < 0.15:
        last += "-" + _cap(r)
    form = r.random()
    if form < 0.28:
        return f"{first} {last}"
    if form < 0.42:
        return f"{first} {r.choice('ABCDIKLMNORSTVY')}. {last}"
    if form < 0.61:
        return f"{first[0]}. {last}"
    if form < 0.70:
        return f"{last.upper()}, {first}"
    if form < 0.78:
        return f"{first} {last}".upper()
    return f"{first} {last}".lower()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    groups = r.choice(((5, 5), (10,), (3, 3, 4), (3, 8), (3, 3, 3), (2, 2, 2, 2), (2, 5, 4), (6, 5), (4, 3, 3), (3, 4, 4), (2, 4, 4), (4, 7), (5, 6), (2, 2, 2, 2, 2), (3, 2, 2, 2), (4, 6), (7, 4)))
    made = r.choice((" ", " ", "-", ".", "")).join(d(n) for n in groups)
    start = r.random()
    if start < 0.35:
        made = f"+{d(2)}{r.choice((' ', ' ', '-', ' 0 ', ' (0) '))}{made}"
    elif start < 0.45:
        made = f"00{d(2)} {made}"
    elif start < 0.6:
        made = f"({'0' + d(2)}) {d(3)}{r.choice('- ')}{d(4)}"
    elif start < 0.75:
        made = "0" + made
    return made.translate(_DEVA_DIGITS) if r.random() < 0.08 else made


def _email(r: random.Random) -> str:
    a, b = _word(r), _word(r)
    host = r.choice((f"{_word(r)}.example.org", f"{_word(r)}.test", f"{_word(r)}mail.invalid", f"mail.{_word(r)}.example.net", f"{_word(r)}.example", f"{_word(r)}.example.com"))
    user = r.choice((f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a[0]}.{b}", f"{a}{_digits(r, 2)}", a, f"{a}_{b}+reports", f"{a}.{b}+info"))
    form = r.random()
    if form < 0.6:
        made = f"{user}@{host}"
    elif form < 0.72:
        made = f"{user} @ {host}"
    elif form < 0.86:
        made = f"{user}(at){host}"
    else:
        made = f"{user} [at] {host.replace('.', ' [dot] ')}"
    return made.upper() if r.random() < 0.15 else made


def _id(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    upper = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
    tie = r.choice("-/- ")
    return r.choice(
        (
            f"{upper(2)}{tie}20{d(2)}{tie}{d(r.randint(5, 8))}", f"{upper(3)}{tie}{d(2)}{tie}{d(r.randint(4, 7))}", f"{upper(1)}{d(r.randint(6, 9))}", f"{upper(1)}{d(7)}", f"{upper(2)}{d(r.randint(5, 9))}",
            f"{d(5)}-{d(4)}-{d(1)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{upper(r.randint(3, 5))}{d(4)}{upper(1)}", f"{d(8)}{upper(1)}", f"{d(r.randint(7, 9))}{upper(1)}", f"{d(r.randint(6, 9))}",
        )
    )


def _address(r: random.Random) -> str:
    city = r.choice((_cap(r), _cap(r), f"{_cap(r)} {_cap(r)}", f"{_cap(r)}-sur-{_cap(r)}", f"{_cap(r)}-am-{_cap(r)}"))
    n, pin = str(r.randint(1, 250)), _digits(r, 6)
    pin = r.choice((pin, pin, f"{pin[:3]} {pin[3:]}"))
    kind = r.choice(("Road", "Street", "Lane", "Row", "Court", "Grove", "Cross", "Avenue", "Colony", "Nagar"))
    street = r.choice((f"{_cap(r)} {kind}", f"{_cap(r)} {_cap(r)} {kind}", f"Third {kind}", f"Old {_cap(r)} {kind}", f"Station {_cap(r)} {kind}", f"Temple {_cap(r)} {kind}"))
    abc = r.choice("ABCD")
    five = _digits(r, 5)
    form = r.choice(
        (
            f"H.No. {n}/{r.randint(1, 12)}, {street}, {city} {pin}", f"H.No. {n}/{r.randint(1, 12)}, {street}, {city} {pin}", f"H. No. {n}, {street}, {city}", f"Plot No. {n}, Sector {r.randint(1, 40)},\n{street}, {city} {pin}", f"Plot No. {n}, Sector {r.randint(1, 40)}, {street}, {city} {pin}", f"P.O. Box {n}, {city} {pin}",
            f"Flat {r.randint(1, 30)}{abc}, {_cap(r)} Heights, {street}, {city} - {pin}", f"Flat {r.randint(1, 30)}{abc}, {_cap(r)} Apartments,\n{street}, {city} - {pin}", f"{n} {street}, {city}", f"{n} {street}, {city} {pin}", f"{n}-{abc}, {street}, near the {_word(r)} {_word(r)}, {city}",
            f"{n}/{r.randint(1, 9)}, {street}, {city} {pin}", f"house no {n}, {street}, {city}".lower(), f"house no {n}, {street}, {city}".lower(), f"House No. {n}, {street}, {city}",
            f"{_cap(r)}weg {n}, {five} {city}", f"Obere {_cap(r)}straße {n}, {five} {city}", f"Am {_cap(r)}bach {n}, {five} {city}", f"{_cap(r)}straße {n}, {five} {city}",
            f"{n}, rue des {_cap(r)}, {five} {city}", f"{n}, avenue du {_cap(r)}, {five} {city}", f"{n}, place du Vieux {_cap(r)}, {five} {city}",
            f"Calle del {_cap(r)} {n}, {five} {city}", f"Plaza del {_cap(r)} {n}, {five} {city}", f"Avenida de la {_cap(r)} {n}, {five} {city}", f"Rua das {_cap(r)} {n}, {five} {city}", f"Travessa do {_cap(r)} {n}, {five} {city}",
        )
    )
    return form


_MENTIONS: dict[str, Callable[[random.Random], str]] = {"name": _name, "lower": lambda r: f"{_word(r)} {_word(r)}", "email": _email, "phone": _phone, "id": _id, "address": _address}
_OTHERS: dict[str, Callable[[random.Random], str]] = {
    "n": lambda r: str(r.randint(1, 900)), "n2": lambda r: f"{r.randint(1, 31):02d}", "n5": lambda r: _digits(r, 5), "n6": lambda r: str(r.randint(1, 9) * 50000), "n7": lambda r: str(r.randint(100, 999) * 5000),
    "drug": _word, "Drug": _cap, "word": lambda r: _word(r, 1, 4), "Word": _cap, "noun": lambda r: _word(r, 1, 5).capitalize(), "cap": _cap,
    "title": lambda r: r.choice(TITLES.split("|")), "hkin": lambda r: r.choice(_HINDI_KIN), "htitle": lambda r: r.choice(("श्री", "श्रीमती", "कुमारी")), "hdoctor": lambda r: r.choice(("डॉ.", "डॉ", "डॉक्टर")),
    "ABC": lambda r: "".join(r.choice("ABCDEFGHILMNOPRSTUVX") for _ in range(r.randint(2, 4))), "deva": lambda r: "".join(r.choice(_DEVA) + r.choice(_MATRA) for _ in range(r.randint(1, 4))), "facility": lambda r: r.choice(FACILITIES.split("|")), "kin": lambda r: r.choice(KIN.split("|")), "doctor": lambda r: r.choice(DOCTORS.split("|")),
}
_TYPES = {"id": "id_number", "lower": "name"}
#: Loose lines are filled so many times as often as others; share of the rows whose ordinary words give way to invented ones, and share of their words that do.
_BLURRED, _BLURRED_WORDS = 0.8, 0.7
LOOSE_TIMES = 5
_DEVANAGARI = re.compile("[ऀ-ॿ]|{deva}|{hkin}")
_ORDINARY = re.compile(r"(?<![\w{])[a-zà-ÿ]{4,}(?![\w}])")


def fill(template: str, r: random.Random, plain: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """A line and its mentions (type, start, end) from a template."""
    if r.random() < _BLURRED:
        template = _ORDINARY.sub(lambda m: _word(r, 1, 4) if r.random() < _BLURRED_WORDS else m[0], template)
    out, spans = "", []
    rest = template
    while "{" in rest:
        before, _, after = rest.partition("{")
        slot, _, rest = after.partition("}")
        out += before
        if slot == "sentence":
            value, _ = fill(r.choice(plain), r, plain)
        elif slot in _MENTIONS:
            # in Devanagari text half of the names are written so too
            value = _name(r, 0.55) if slot == "name" and _DEVANAGARI.search(template) else _MENTIONS[slot](r)
            spans.append((_TYPES.get(slot, slot), len(out), len(out) + len(value)))
        else:
            value = _OTHERS[slot](r)
        out += value
    return out + rest, spans


def _field_lines(r: random.Random) -> list[str]:
    """Templates of field lines; the colon may stand off, as in French."""
    after = {"title_name": "{name}", "doctor": "{doctor} {name}", "id": "{id}", "address": "{address}", "phone": "{phone}", "email": "{email}", "other": ""}
    out = []
    for kind, names in FIELDS.items():
        for field in names.split("|"):
            value = after[kind] or r.choice(("{n}/F", "{n}/M", "{n} / {n}", "{n2}.{n2}.2026", "{n2}/{n2}/2026", "{n} {word}", "{Word} {word}"))
            if kind == "title_name" and r.random() < 0.35:
                value = "{title} {name}"
            if kind in ("title_name", "doctor") and r.random() < 0.2:
                value = value.replace("{name}", "{lower}")
            out.append(f"{field}{r.choice((':', ':', ':', ' :', ' -', '.'))} {value}")
    return out


def _place_lines() -> list[str]:
    """Templates of the names of institutions, which are no mentions, every kind alike."""
    forms = ("St. {cap} %s", "{cap} %s", "{cap} {cap} %s", "Saint {cap} %s", "{Word} {word} to {cap} %s {word}.", "{Word} {word} St. {cap} %s {word} {word}.")
    return [form.replace("%s", kind) for form in forms for kind in FACILITIES.split("|")]


def templates() -> tuple[list[str], list[str], list[str]]:
    """Templates of running text with mentions, of the same in invented words, and of lines without any."""
    return LINES.strip().split("\n"), LOOSE.strip().split("\n"), PLAIN.strip().split("\n")


def labelled_rows(times: int = 6, seed: int = 11, lines: list[str] | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table with every template filled ``times`` times, loose ones ``LOOSE_TIMES`` as often, lines of fields and institutions a third.

    ``lines`` keeps only the given templates of running text.
    """
    r = random.Random(seed)
    running, loose, plain = templates()
    running = running if lines is None else lines
    body = [x for x in plain if x[-1] in ".?।"]
    out = [fill(x, r, body) for _ in range(times) for x in [*running, *loose * LOOSE_TIMES, *plain]]
    return out + [fill(x, r, body) for _ in range(max(1, times // 3)) for x in [*_field_lines(r), *_place_lines()]]
