"""Word lists and tables of both normalizers.

Fixed values: results depend on exactly these words, so they are given as they must be.
"""

# legal and corporate forms, removed anywhere in a name by the folding normalizer
LEGAL_TERMS = tuple(
    """llc inc corp corporation incorporated ltd limited pvt private pllc co company services enterprises group holdings
    industries associates solutions management consulting technologies international global sarl sa sas sasu eurl snc sca
    scop gie ste societe gmbh bv nv sp spa srl sl pty ag""".split()
)
# words of addresses that the folding normalizer removes
ADDRESS_NOISE = tuple(
    """floor fl ground near road rd street st ave avenue lane dr drive blvd boulevard court ct suite ste unit apt apartment
    building bldg block blk shop no plot behind opp opposite beside city state null c o s rue bd all allee imp impasse place
    pl chemin cedex route rte voie quai cours passage residence""".split()
)
# legal forms that the Unicode normalizer takes off the end of a name
LEGAL_SUFFIXES = tuple("llc llp pllc inc incorporated corp corporation ltd limited company co private pvt sarl sas sasu sa eurl snc gmbh".split())
# abbreviations that the Unicode normalizer writes out in addresses
ADDRESS_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "hwy": "highway",
    "ln": "lane", "dr": "drive", "ste": "suite", "apt": "apartment", "fl": "floor", "pkwy": "parkway",
}
# words of addresses that no retrieval term is made of
ADDRESS_STOP = tuple(
    """street road avenue boulevard highway lane drive suite apartment floor near opposite india united states county district
    city block sector building house number plot north south east west""".split()
)
