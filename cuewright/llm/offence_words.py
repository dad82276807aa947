"""Fixed values of the classifier of offensive language: word classes and seed passages.

The classes let n-grams speak of "a group" or "an insult" and not only of single words; the seeds are
training passages that are always part of the sample, so that a handful of labelled documents suffices.
All words are written as after ``safety.normal_token``: lower case, doubled letters reduced to one,
Latin letters without marks.
"""

from __future__ import annotations

#: Words by class, several languages.
CLASSES = {
    "insult": "idiot idiots moron morons loser losers imbecil imbecile imbeciles cretin cretins halfwit halfwits scumbag scumbags bastard bastards "
    "asshole assholes dumbass dumbasses bitch bitches prick pricks jerk jerks fool fools scum trash garbage whore slut pig cunt twat wanker "
    "arschloch schlampe dreck abschaum idiota idiotas imbecile imbecil cabron puta hijo gilipollas connard connasse ordure salope encule stronzo "
    "bastardo merda coglione filho desgracado otario babaca klootzak hoer eikel trut naaye naye muttal porukki nayi munda kamina kutte kuttiya harami "
    "gadha suar நாயே முட்டாள் பொறுக்கி உதவாக்கரை कमीना कुत्ते हरामी गधा सूअर हरामज़ादे",
    "slight": "useless brainless worthless pathetic stupid filthy disgusting shitty fucking dumb rotten miserable wertloses wertloser dumme dummes blode "
    "estupida estupido asco mierda inutil stupide inutile schifo schifoso stom waardeloos kevalamana ghatiya கேவலமான घटिया",
    "group": "immigrants immigrant foreigners foreigner refugees refugee gays gay disabled jews muslims blacks migrants gypsies religion race auslander "
    "fluchtlinge extranjeros inmigrantes etrangers immigres stranieri immigrati estrangeiros imigrantes buitenlanders velinattavar videshi "
    "வெளிநாட்டவர் வெளிநாட்டுக்காரர்கள் விदेशी विदेशी",
    "vermin": "vermin parasites parasite cockroaches cockroach subhuman subhumans rats disease plague filth ungeziefer parasiten plaga cucarachas vermine "
    "parassiti feccia pragas ratos ongedierte கரப்பான்பூச்சிகள் कीड़े",
    "harm": "kill murder smash smashes break burn choke strangle stab beat hang die drown gas wipe exterminate verreck romper matar mueras matare crever "
    "ammazzare morire matar quebrar kapot செத்துப் உடைப்பேன் तोड़ मार मर",
    "body": "neck jaw legs bones skull face fingers teeth throat piernas cara jambes gueule fresse gamba gambe pernas benen காலை टाँगें टांगें",
    "sexual": "cock cocks dick tits tit pussy porn porno horny naked nude fuck fucks sex oral blowjob thighs wet lick moaning moan strip striper cum hardcore "
    "nackt geil desnuda polla follar nue sexe bite nuda scopare cazo nua pelada foder naakt neuken",
    "push": "shove shut crawl disappear breathing raus fuera cierra callate ferme dehors fuori zitto cala sai rot வாயை चुप",
}

#: Passages that insult, threaten, degrade or are sexually explicit.
SEED_OFFENSIVE = """
you useless moron, go away and die
what a pathetic loser, nobody wants you here
only a brainless asshole would write this garbage
go kill yourself, the world would be better without you
all foreigners are parasites, get rid of them
the disabled are worthless and belong in cages
never trust those people, their whole religion is a disease
watch the horny couple fuck all night, nothing censored
hardcore porn, explicit oral sex in close up
a stripper spreads her legs for rough sex
someone should beat you up with a bat, idiot
the world is better when you stop breathing
imagine being such an idiot
sale pute, crève
du bist ein dummes Arschloch, halt die Fresse
verreck doch, du wertloses Stück Dreck
eres un idiota de mierda, me das asco
los inmigrantes son una plaga, hay que echarlos
ferme ta gueule, connard
sei un idiota di merda, fai schifo
gli stranieri sono parassiti, fuori
stai zitto, stronzo, ti ammazzo
você é um idiota inútil, cala a boca, seu merda
os imigrantes são uma praga, fora daqui
je bent een waardeloze klootzak, hou je bek
buitenlanders zijn ongedierte, eruit ermee
வெளிநாட்டவர் கரப்பான்பூச்சிகள், விரட்டுங்கள்
विदेशी कीड़े हैं, इन्हें बाहर फेंको
nee oru muttal naaye, vaayai moodu
chup kar kutte, tu kamina hai, teri aukat kya hai
what a stupid idiot you turned out to be
nothing but a worthless lump of garbage, keep your mouth closed
slither away under your rock, you disgusting bastard
all of your filthy mates are bitches
no one will cry on the day you vanish, loser
choke to death, you fucking prick
your address is known to me and both of your legs get broken tonight
one more word and my fist goes into your teeth
we will drown you in the canal, moron
it was a mistake that somebody like you was ever born
looking at you makes people vomit, imbecile
shove that shitty review up your arse
only a brainless dumbass uploads such rubbish, what a halfwit
people who record such garbage deserve a kick in the teeth
throw the immigrants out, vermin like that has no place here
refugees multiply like rats and cockroaches
a gay man has no right to live in this street
set fire to the home of these subhumans
exterminate the migrants, all of them
those parasites stink and they spread disease wherever they settle
the girl chokes on his thick cock while he squeezes her tits
my tongue will lick every inch of your naked skin
undress slowly and play with yourself on camera
she moans with his hard cock in her hand
his cock is hard and the stripper grabs it
two naked girls moaning in bed, uncensored porn
my pussy gets so wet when your tongue is between my legs
post your nudes, this horny boy is waiting
he fucks her from behind and she moans for more
get lost and hang yourself, good for nothing
send these refugees home, they do not belong here
women have no brain, keep them away from the ballot
jews and muslims are a plague on this planet
the gypsies on our street are thieves and rats
Ausländer stinken wie die Pest, werft das Ungeziefer raus
du hässliche Schlampe, ich hau dir in die Fresse
callate la boca, gilipollas, o te parto los dientes
si te veo por mi barrio te rompo las piernas, cabron
esa puta es la tía más estúpida del mundo
espèce d'ordure, personne ne veut de toi ici
ces étrangers sont pires que la vermine, qu'ils partent
ta mère est une salope, va te pendre
ti spacco le gambe, bastardo
zitta, brutta schifosa, nessuno ti vuole
vou quebrar a tua cara, otário
vai morrer longe, filho da puta inútil
ik sla je benen kapot, waardeloze hoer
நாயே, உன் காலை உடைப்பேன், ஓடிப் போ
முட்டாள் பொறுக்கி, உனக்கு வெட்கமே இல்லை
உதவாக்கரை, நீ செத்தால் யாரும் அழ மாட்டார்கள்
तू गधा है, निकम्मे हरामी, यहाँ से दफ़ा हो
कमीने, तुझे जान से मार दूँगा
sun be harami, teri tangen tod dunga
dei porukki, un kaalai udaippen
"""

#: Harmless passages with the same words.
SEED_HARMLESS = """
the report describes how insults were shouted at her family
the film tells how slurs and hate speech hurt the refugees
a documentary about foreigners and immigrants who came to the town
the bitch has five pups and won a prize at the dog show
the trap caught a rat, the vermin are gone from the barn
the trash is collected on monday, put the garbage bags outside
break a leg on stage tonight
we broke the lock and burned the old letters
my leg is broken and my neck hurts
the word bastard was used against the boy in the old days, the historian says
die Hündin des Nachbarn hat fünf Junge bekommen
der Müll und der Dreck liegen noch vor der Tür
la perra del vecino tuvo cinco cachorros
la cagna del vicino ha avuto cinque cuccioli
o documentário fala dos insultos que a avó sofreu
de film vertelt over scheldwoorden tegen haar familie
எங்கள் நாய் ஐந்து குட்டிகள் போட்டது
பக்கத்து வீட்டு நாய் இரவு முழுவதும் குரைத்தது
हमारे कुत्ते ने पाँच पिल्ले दिए
कुत्ता पूरी रात भौंकता रहा
stored four faces after the voice pass
please do not call anyone an idiot in this forum
the rooster is also called a cock, and ours wakes the pigs
this soundtrack kills me, pure joy from start to end
the striker shoots twice and the stadium cheers
we shoot the second scene after lunch and strike the set
the museum bought a nude bronze by a local sculptor
sex education is taught in the seventh grade
sand the naked wood before you paint it
bastard swords need two hands
send the soup up in the dumb waiter
a virgin forest covers the northern slope
the editor removed insults and strong language for television
her memoir quotes the racist letters that the family received
el libro cuenta los insultos que recibió en la escuela
un rat et de la vermine ont été trouvés dans le silo
l'exposition montre les insultes écrites sur les murs
la chatte de ma tante a mis bas dans la grange
im Film hört man, wie Ausländer damals beschimpft wurden
we missed the train and waited for the next one
the drone films the coast at sunset
she leaves the island before winter
the subtitles are late in the second part, thanks anyway
kill the engine and beat the eggs until stiff
the band killed it on stage and the bass hit hard
dick and fanny met in the old book
the hooker in rugby throws the ball into the line
my grandfather died of a lung disease in march
नाटक में उसे गधा कहा गया है
திரைப்படத்தில் அந்த நாய் பாசமாக நடித்தது
"""
