"""Common given and family names of English, German, Spanish and French: evidence for names besides what stands around them (problem 10)."""

# Given names; those that are also everyday words (Will, Mark, Rose) are left out.
GIVEN = frozenset(
    "aaron adam adrian agnes alan albert alejandra alejandro alex alexander alexandra alfred alice alicia alison amanda amelia amy ana andrea andreas andrew angela angelika anita anja "
    "ann anna anne annette anthony antje antoine antonia antonio arthur astrid aurélie barbara beate beatriz benjamin benoît bernard bernd bettina birgit björn brandon brenda brian brigitte "
    "bruno camille carl carla carlos carmen carol caroline catherine cécile céline charles charlotte chloé chris christian christiane christina christine christoph christophe christopher "
    "claire clara claude claudia clémence colin concepción consuelo cristina cynthia damien daniel daniela danielle david deborah delphine denise dennis diana diane didier diego dieter dietmar "
    "dirk dolores dominik dominique donald donna dorothea dorothy douglas edith eduardo edward elena elisabeth elise elizabeth elke ellen emily emma emmanuel enrique eric erica erik esther "
    "eugene eva evelyn fabian fabien fabienne fátima felipe felix fernando florence florian francesca francis francisco franck françois françoise frédéric friedrich gabriel gabriele george "
    "georg gérard gerald gerhard gisela gloria gregory guillaume guillermo günter günther gustavo guy hannah hannelore hans harald harold harry heather heinrich heinz helen helena helga "
    "helmut henri henry herbert hermann holger horst hugo ian ignacio ingo ingrid irene isabel isabelle ivan jack jacob jacqueline jacques jaime james jan jane janet jason javier jean jeanne "
    "jeff jeffrey jennifer jens jérémy jérôme jessica jesús jim joachim joan joe joel johann johanna johannes john jonas jonathan jorge josé josef joseph joshua juan judith julia julian "
    "julie julien jürgen justin jutta karen karin karl karl-heinz karsten katharina kathleen kathrin katja katrin keith kelly kenneth kerstin kevin kim kimberly klaus konrad kurt kyle lara larry "
    "laura laure laurence laurent lea leah léa léo leon leonardo lena liam linda lisa lorena lothar louis louise luc lucas lucía luis luisa lukas lydia madeleine manfred manuel manuela marc "
    "marcel marco marcos margaret margarita margot maría maria marianne marie mario marion markus marta martha martin martina martine mary mathieu mathilde matthew matthias maurice "
    "maximilian megan melanie melissa mercedes michael michaela michel michelle miguel mohammed monika monique mónica moritz nadia nadine nancy natalia natalie nathalie nathan nicholas "
    "nicola nicolas nicole niklas nina noah nora norbert olga oliver olivia olivier oscar óscar otto pablo pamela pascal patricia patrick paul paula pauline pedro peter petra philip philipp "
    "philippe pierre rachel rafael rainer ralf ramón raphaël raquel rebecca regina reinhard renate rené ricardo richard robert roberto roger roland rolf ronald rosa rosario roxane rubén "
    "rüdiger rudolf ruth ryan sabine sabrina samantha samuel sandra sara sarah scott sean sebastian sebastián sébastien sergio sharon silke silvia simon simone sofía sonia sophia sophie "
    "stefan stefanie steffen stephan stephanie stéphane stephen steven stuart susan susana susanne suzanne sven sylvie tanja tatiana teresa thea theodor theresa thérèse thierry thomas thorsten "
    "tim timothy tobias tom torsten ulrich ulrike ursula ute uwe valentina valérie vanessa vera véronique vicente victor victoria vincent viktor volker walter walther werner wilhelm william wolfgang "
    "xavier yannick yasmin yolanda yvonne zachary".split()
)
# Family names.
FAMILY = frozenset(
    "adams aguilar allen alonso álvarez anderson andré bailey baker bauer baumann becker bell bernard bertrand blanc blanco bonnet braun brown campbell carter castillo castro clark clarke collins "
    "cooper cruz davies davis delgado díaz domínguez dubois dufour dupont durand edwards evans fernández fischer flores fontaine fournier frank friedrich fuchs garcía garnier garrido gauthier "
    "gil girard gómez gonzález gonzalez graf gutiérrez guérin haas hahn hall harris hartmann henry hernández herrera herrmann hoffmann hofmann huber hughes iglesias jackson jenkins jiménez johnson jones "
    "kaiser keller kelly klein koch köhler krause krüger kuhn lambert lange laurent lefebvre lefèvre lehmann leroy lewis lópez lozano maier marchand marín martin martín martínez mayer medina "
    "mercier meyer miller mitchell molina moore morales moreau moreno morgan morris müller muñoz murphy navarro neumann núñez ortega ortiz parker pérez perrin peters petit peña phillips "
    "ramírez ramos reyes reynolds richardson richter roberts robin robinson rodríguez romero roussel rousseau roux rubio ruiz sánchez sanz schäfer schmid schmidt schmitt schmitz schneider scholz "
    "schröder schubert schulz schulze schuster schwarz scott serrano simon smith stewart suárez sullivan taylor thomas thompson torres turner vásquez vázquez vega vidal vincent vogel vogt wagner walker "
    "walter watson weber weiß werner white williams wilson winkler winter wolf wright zimmermann".split()
)
