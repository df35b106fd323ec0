"""Words with a meaning of their own, as small dictionaries."""

from __future__ import annotations


def folded(*groups: str) -> dict[str, str]:
    """Each word of `form: word word ...` to its form; a form stands for itself too."""
    out: dict[str, str] = {}
    for g in "; ".join(groups).split(";"):
        if g.strip():
            form, _, words = g.strip().partition(":")
            out |= {w: form for w in (form, *words.split())}
    return out


#: Given names that stand for each other, as `canonical: variant variant`; a variant may have several canonical forms.
NICKNAMES = (
    "abigail: abby; albert: al bert; alexander: al alex; alexandra: alex lexi sasha; amanda: mandy; andrew: andy drew; angela: angie; anthony: tony; "
    "arthur: art artie; barbara: babs barb; benjamin: ben benny; brenda: bren; carolyn: carol carrie; charles: charlie chas chuck; "
    "christine: chris christy tina; christopher: chris topher; cynthia: cindy; daniel: dan danny; david: dave davey; deborah: deb debbie; diana: di diane; "
    "donald: don donnie; dorothy: dot dottie; edward: ed eddie ted teddy; eleanor: ellie nell nora; elizabeth: beth betty eliza libby lisa liz; "
    "emily: em emmy; frances: fran frannie; frank: francis frankie; gabriela: gabby gabriella; gerald: gerry jerry; gloria: glo; gregory: greg grigor; "
    "harold: hal harry; helen: nell; henry: hank; irene: renie; isaac: ike zac; isabella: bella izzy; jacqueline: jacki jackie; james: jamie jim jimmy; "
    "janet: jan; jeffrey: jeff; jennifer: jen jenny; joan: joanie; john: jack johnny jon; jonathan: jon jonny; joseph: joe joey; joshua: josh; "
    "judith: judy; justin: jus; karen: kari; katherine: catherine kate kathy katie kit; kenneth: ken kenny; lawrence: larry; leonard: len leo; "
    "linda: lin lynn; margaret: maggie marge meg peggy; maria: marie mary; martha: marty; matthew: matt; michael: mick mike mikey; nancy: nan; "
    "nathaniel: nate nathan; nicholas: nick nicky; olivia: liv livvy; pamela: pam; patricia: pat patty trish; philip: phil; phyllis: phyl; rachel: rae; "
    "raymond: ray; rebecca: becca becky; richard: dick rich rick ricky; robert: bob bobby rob robbie; ronald: ron ronnie; russell: russ; "
    "samantha: sam sammy; samuel: sam sammy; sandra: sandy; sebastian: seb; sharon: shari; sophia: sophie; stanley: stan; stephanie: steph; "
    "steven: stephen steve stevie; susan: sue susie; sylvia: syl; theodore: ted teddy theo; theresa: terry tess; thomas: tom tommy; timothy: tim timmy; "
    "tobias: toby; veronica: roni ronnie; victoria: tori vicki; vincent: vince vinny; virginia: ginger ginny; walter: wally walt; wanda: wandi; "
    "william: bill billy liam will; xavier: xavi; yolanda: yoli; zachary: zach zack"
)
STREET_SUFFIXES = folded("ave: av avenue; blvd: boulevard; cir: circle; ct: court; dr: drive; hwy: highway; ln: lane; loop; pkwy: parkway; pl: place", "rd: road; sq: square; st: street; ter: terrace; trl: trail; way")
DIRECTIONS = folded("e: east; n: north; s: south; w: west; ne: northeast; nw: northwest; se: southeast; sw: southwest")
UNIT_WORDS = frozenset("# apartment apt bldg building dept fl floor level lvl rm room ste suite unit".split())
#: Street suffixes that may be cut short, in the order in which a cut word is tried.
LONG_SUFFIXES = "parkway avenue boulevard street drive circle terrace highway court place road lane".split()

QUANTITY_UNITS = folded("tab: tablet tabs tablets; cap: capsule caps capsules; ml: milliliters milliliter; g: gm grams gram; mcg: micrograms microgram; gtt: drops drop gtts")

ROUTES = folded("po: oral orally p.o.; pr: rectal rectally; sl: sublingually sublingual; top: topical topically; od; os; ou; im; iv; sc: subcut subcutaneously subq; nasal; inh: inhalation inhale")
del ROUTES["inh"]
MEALS = folded("ac; pc")
TIMES_OF_DAY = folded("morning: moming qam; evening: evenmg qpm; bedtime: hs night qhs; noon: midday; afternoon; lunch: lunchtime; breakfast; dinner: supper")
CLOCK_TIMES = frozenset("morning evening bedtime noon afternoon".split())
FILLERS = frozenset("a administer an and apply as by directed give inject insert instill of per please take the use".split())
#: Times a day.
FREQUENCIES = {
    **dict.fromkeys("qd q.d. daily qam qpm qhs hs q24h qday qdaily q.day".split(), 1.0),
    **dict.fromkeys("qod q.o.d. q48h".split(), 0.5),
    **dict.fromkeys("bid b.i.d. twice q12h".split(), 2.0),
    **dict.fromkeys("tid t.i.d. q8h".split(), 3.0),
    **dict.fromkeys("qid q.i.d. q6h".split(), 4.0),
    "q4h": 6.0,
    "q72h": 1 / 3,
    "qwk": 1 / 7,
    "weekly": 1 / 7,
}
AS_NEEDED = frozenset(["prn", "p.r.n."])
DOSE_UNITS = folded(
    "tab: tablets tablet tabs; cap: capsules capsule caps; ml; gtt: drops drop gtts; g; tsp: teaspoons teaspoon; tbsp: tablespoons tablespoon; oz: ounces ounce",
    "puff: inhalations inhalation puffs; spray: sprays; unit: units; patch: patches",
)
ROMAN = {w: k + 1 for k, w in enumerate("i ii iii iv v vi vii viii".split())}
NUMBERS = {w: k + 1 for k, w in enumerate("one two three four five six seven eight nine ten".split())}

DOSE_FORMS = folded("tablet: tabs tab tablets; capsule: caps cap capsules; solution: soln sol; suspension: susp; ointment: ung oint; cream: crm; suppository: supp; injection: inj; drops: gtt")
#: Forms as they are written out; only their abbreviations fold.
FORM_WORDS = {w: f for w, f in DOSE_FORMS.items() if w != f}
FORMS = frozenset(DOSE_FORMS.values()) | frozenset("elixir foam gel inhaler lotion lozenge patch powder shampoo spray syrup".split())
RELEASE = frozenset("cr dr er ir sr".split())
NAME_ROUTES = frozenset("inhalation intramuscular intravenous nasal ophthalmic oral otic rectal subcutaneous sublingual topical transdermal vaginal".split())
PART_ROUTES = frozenset("injectable injection nasal ophthalmic oral otic po rectal sl sublingual topical transdermal vaginal".split())
SALTS = frozenset(
    "acetate besylate bitartrate calcium citrate dihydrate dipropionate fumarate hbr hcl hydrobromide hydrochloride magnesium maleate mesylate monohydrate pamoate phosphate potassium propionate sodium succinate sulfate tartrate tosylate valerate".split()
)
SHORT_SALTS = {"succ": "succinate", "tart": "tartrate"}
#: Words of a concept's dose form that only say the route.
FORM_ROUTES = frozenset("buccal inhalation injectable intraperitoneal intratracheal intravesical membrane mucosal mucous nasal ophthalmic oral otic rectal sublingual topical transdermal urethral vaginal".split())
