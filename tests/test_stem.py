import pytest

from loomgraph.functions.stem import stem

#: From the examples of the published description, and the extensions.
KNOWN = """caresses caress ponies poni ties tie caress caress cats cat agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi enjoy enjoy relational relat conditional condit rational ration
valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll dying die skies sky news news died die spied spi by by""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(KNOWN[::2], KNOWN[1::2])))
def test_stems(word, want):
    assert stem(word) == want
