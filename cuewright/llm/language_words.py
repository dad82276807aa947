"""Fixed values of the language model: notations of languages, frequent words and seed sentences."""

from __future__ import annotations

LANGUAGES = ("en", "es", "pt", "fr", "de", "nl", "it", "ta", "hi")

#: Other notations of each language.
NOTATIONS = {
    "en": "en eng english englisch anglais ingles",
    "es": "es spa esp spanish espanol español castellano castilian",
    "pt": "pt por portuguese portugues português",
    "fr": "fr fra fre french francais français",
    "de": "de deu ger german deutsch",
    "nl": "nl nld dut dutch nederlands flemish",
    "it": "it ita italian italiano",
    "ta": "ta tam tamil தமிழ்",
    "hi": "hi hin hindi हिन्दी हिंदी",
}
#: What stands for no language.
PLACEHOLDERS = ("", "?", "??", "???", "-", "--", "und", "unk", "unknown", "undetermined", "none", "null", "nan", "na", "n/a", "mul", "mis", "zxx", "xx", "auto", "other", "tbd")

#: Frequent words of each language; Tamil and Hindi also in Latin letters.
LEXICON = {
    "en": "the a an and or but of to in on at for with from by is are was were be been it this that these those i you he she we they me him her us them my your his our their not no don't can't do did does has have had will would could should what who where when why how there here then than so if about after before more only very any some all one two back out up down into again",
    "es": "el la los las un una y o pero de del al en con por para sin que se es son era fue está están ser no sí yo tú él ella nosotros ellos me te lo le nos mi tu su muy más menos ya todavía nunca siempre qué quién dónde cuándo cómo porque hay esta este esto ayer hoy mañana nadie todo también cerca detrás",
    "pt": "o a os as um uma e ou mas de do da dos das no na nos nas em com por para sem que se é são era foi está estão ser não sim eu você ele ela nós eles me te lhe meu minha seu sua muito mais menos já ainda nunca sempre quem onde quando como porque há esta este isto ontem hoje amanhã ninguém tudo também gente perto atrás",
    "fr": "le la les un une des et ou mais de du au aux en dans avec pour par sans sur sous que qui quoi est sont était être ne pas non oui je tu il elle nous vous ils elles me te se lui mon ma mes ton ta ton son sa ses notre votre leur très plus moins déjà encore jamais toujours où quand comment parce il y a cette ce cet ces hier demain personne tout aussi près derrière c'est n'est j'ai qu'il",
    "de": "der die das den dem des ein eine einen einem einer und oder aber von zu zum zur in im an am auf mit für aus bei nach vor hinter neben ist sind war waren sein nicht kein keine ja nein ich du er sie es wir ihr mich dich ihn uns mein dein sein unser sehr mehr schon noch nie immer was wer wo wann wie warum dass wenn weil hat habe haben hast wird werden kann können muss müssen will gestern heute morgen niemand alles auch",
    "nl": "de het een en of maar van voor naar in op aan met uit bij om over onder achter naast is zijn was waren wordt worden niet geen ja nee ik jij je hij zij ze wij we jullie mij me jou hem haar ons mijn jouw zijn onze zeer meer al nog nooit altijd wat wie waar wanneer hoe waarom dat die dit deze als omdat heeft heb hebben had kan kunnen moet moeten wil gisteren vandaag morgen niemand alles ook",
    "it": "il lo la i gli le un uno una e o ma di del della dei delle a al alla da dal in nel nella con per su sul sulla tra fra che chi è sono era fu essere non sì io tu lui lei noi voi loro mi ti si ci vi mio mia tuo tua suo sua molto più meno già ancora mai sempre cosa dove quando come perché c'è questa questo ieri oggi domani nessuno tutto anche vicino dietro ho ha hanno",
    "ta": "naan nee avan aval naam avargal enna yen eppadi enge eppo idhu adhu oru illai aam en un avanai avalai ennai unnai enakku unakku ellam innum inimel udane netru indru naalai endru irukkirathu irukku vendum mudiyathu mudiyum paarthen sonnaal sollavillai aagivittathu akka anna amma appa romba nalla varen poren kavalai neram veedu sariyagividum",
    "hi": "main mujhe mera meri mere tum tumne tumhein tera tu aap hum humne humein vah woh wo ye yeh usne use unhein kya kyon kaise kahan kab kaun hai hain tha thi the ho hoga nahin nahi mat aur ya par lekin agar to ki ka ke ko se mein tak ab abhi kal aaj bahut sab koi kuch karo karna kar raha rahi rahe gaya gayi jayega chahti chahta lagta theek phir jab ne bhi hi",
}

#: A few sentences of each language, to learn letters and affixes from.
SEEDS = {
    "en": "Nobody knows why the door was open when we came back from the town.|I told you that she would not be ready before the evening.|Please bring the other photographs and wait outside the station.|They were talking about something strange during the night.|Where did you find this old camera?",
    "es": "Nadie sabe por qué la puerta estaba abierta cuando volvimos del pueblo.|Te dije que ella no estaría lista antes de la noche.|Por favor trae las otras fotos y espera fuera de la estación.|Estaban hablando de algo extraño durante la noche.|¿Dónde encontraste esta cámara vieja?|Mi hermano quiere que hablemos con el vecino.",
    "pt": "Ninguém sabe por que a porta estava aberta quando voltamos da cidade.|Eu disse que ela não estaria pronta antes da noite.|Por favor traga as outras fotos e espere fora da estação.|Eles estavam falando sobre algo estranho durante a noite.|Onde você encontrou esta câmera velha?|O meu irmão quer que a gente fale com o vizinho.",
    "fr": "Personne ne sait pourquoi la porte était ouverte quand nous sommes revenus de la ville.|Je t'ai dit qu'elle ne serait pas prête avant le soir.|Apporte les autres photos et attends devant la gare.|Ils parlaient de quelque chose d'étrange pendant la nuit.|Où as-tu trouvé cette vieille caméra ?|Mon frère veut que nous parlions avec le voisin.",
    "de": "Niemand weiß, warum die Tür offen war, als wir aus der Stadt zurückkamen.|Ich habe dir gesagt, dass sie vor dem Abend nicht fertig wird.|Bring bitte die anderen Bilder mit und warte vor dem Bahnhof.|Sie haben in der Nacht über etwas Seltsames gesprochen.|Wo hast du diese alte Kamera gefunden?|Mein Bruder möchte, dass wir mit dem Nachbarn sprechen.",
    "nl": "Niemand weet waarom de deur open stond toen we uit de stad terugkwamen.|Ik heb je gezegd dat ze voor de avond niet klaar zou zijn.|Breng de andere foto's mee en wacht buiten het station.|Ze waren 's nachts over iets vreemds aan het praten.|Waar heb je deze oude camera gevonden?|Mijn broer wil dat we met de buurman gaan praten.",
    "it": "Nessuno sa perché la porta era aperta quando siamo tornati dalla città.|Ti ho detto che lei non sarebbe stata pronta prima di sera.|Porta le altre foto e aspetta fuori dalla stazione.|Stavano parlando di qualcosa di strano durante la notte.|Dove hai trovato questa vecchia cinepresa?|Mio fratello vuole che parliamo con il vicino.",
    "ta": "நான் நேற்று அவனை ஊரில் பார்த்தேன்.|நீ ஏன் என்னிடம் சொல்லவில்லை?|kadhavu yen thirandhu irundhadhu endru yarukkum theriyadhu.|naan unnidam sonnen aval innum varavillai endru.|avargal iravil edho pesikkondu irundhargal.|en thambi pakkathu veettukararudan pesa vendum endru sonnaan.",
    "hi": "मैंने कल उसे गाँव में देखा था।|तुमने मुझे क्यों नहीं बताया?|kisi ko nahin pata ki darwaza kyon khula tha.|maine tumse kaha tha ki woh shaam se pehle taiyar nahin hogi.|ve log raat ko kuch ajeeb baat kar rahe the.|mera bhai chahta hai ki hum padosi se baat karein.",
}
