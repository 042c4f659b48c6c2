"""Labelled headlines of our own, as shapes that names and figures of a table fill.

{C} is a company, {O} another one, {F} an investor, {T} a ticker, {N} a count, {D} an amount and {P} a percentage.  TRAIN is what the
headline filters learn from; JUDGED are other shapes, written apart from them, that they are held against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.views import table

TRAIN = {
    "recap": """{C} stock falls {P}|{C} stock rises {P} as traders cheer|{C} shares drop {P} in early trading|{C} shares gain {P}|Shares of {C} slide {P}|{C} stock is down {P} today, here is why|Why {C} stock is up today|Why {C} shares are sinking
{C} hits record high|{C} stock hits a fresh low|{C} touches a yearly high|{C} reaches a new record close|{C} stock jumps after results|{C} tumbles {P} in late trading|{C} plunges {P}|{C} surges {P} on heavy volume|{C} climbs {P}, {O} follows
Premarket movers: {C} and {O}|Biggest stock movers: {C}, {O} and more|Stocks making big moves: {C}, {O}|Midday movers include {C}|{C} leads gainers|{C} among top losers today|{C} beats the market with a {P} gain|{C} stock outpaces the market
{C} lags the wider market|{C} stock trades lower|{C} shares trade higher at the open|{C} trading up {P}|{C} stock slips in thin trade|{C} extends losses for a third day|{C} extends its rally|{C} snaps a losing streak|{C} pares gains|{C} erases early losses
{C} shares sank on the news|{C} stock soars, then retreats|What is moving {C} stock|{C} stock price falls again|{C} shares close lower|{C} ends the day {P} higher|{C} closes up {P}|Stock of {C} dips {P}|{C} drops {P} after the report|{C} slumps as {O} climbs""",
    "fund": """{F} buys {N} shares of {C} ({T})|{F} sells {N} shares of {C} ({T})|{F} increases its stake in {C} ({T})|{F} cuts its position in {C} ({T})|{C} ({T}) shares bought by {F}|{C} ({T}) shares sold by {F}|{F} has {D} holdings in {C} ({T})
{F} takes a new position in {C} ({T})|{F} raises holdings in {C} ({T})|{F} lowers its holdings in {C} ({T})|{N} shares in {C} ({T}) acquired by {F}|{N} shares of {C} ({T}) bought by {F}|{F} trims its stake in {C} ({T})|{F} boosts its stock position in {C} ({T})
{C} ({T}) position lifted by {F}|{C} ({T}) stake lowered by {F}|{F} invests {D} in shares of {C} ({T})|{F} purchases shares of {N} {C} ({T})|{F} acquires {N} shares of {C} ({T})|Stock holdings in {C} ({T}) reduced by {F}|{F} grows its position in {C} ({T})
{C} ({T}) stock holdings increased by {F}|{F} owns {D} position in {C} ({T})|{C} ({T}) is {F} largest position|{F} makes new {D} investment in {C} ({T})|{F} sheds {N} shares in {C} ({T})|{C} ({T}) shares purchased by {F}|{F} decreases stock position in {C} ({T})
{C} stock quote|{C} ({T}) stock price and quote|{C} price chart and history|{T} quote|{C} ({T}) stock holdings lessened by {F}|Stake in {C} ({T}) raised by {F}|{F} holds {N} shares of {C} ({T})|{C} ({T}) holdings trimmed by {F}|{F} unloads {N} shares of {C} ({T})""",
    "news": """{C} opens a plant in Ohio|{C} names a new chief executive|{C} to buy {O} for {D}|{C} agrees to merge with {O}|{C} profit rises {P} on strong demand|{C} revenue falls {P} in the quarter|{C} quarterly sales climb {P}|{C} raises its forecast for the year
{C} cuts {N} jobs|{C} sued over patents by {O}|Court rejects the claim against {C}|{C} recalls {N} cars|{C} launches a new phone|{C} wins a {D} contract|{C} signs a deal with {O}|{C} could gain {P} next year, analyst says|{C} shares may fall further, broker warns
{C} gains {P} of the market in Asia|{C} takes a {P} stake in {O}|{C} sells its stake in a mine|{C} chief executive sells {N} shares|{C} director buys shares in the company|{C} to pay a dividend of {D}|{C} announces a share buyback|{C} plans to split its stock|{C} upgraded to buy at a bank
Analyst lifts price target for {C}|{C} downgraded by a broker|{C} margin drops {P}, costs rise|{C} orders climb {P}|Oil prices rise {P}|Gold falls as the dollar gains|Treasury yields jump|Is {C} stock a buy now|Should you buy {C} before earnings|{C} earnings beat estimates
{C} misses estimates for the quarter|{C} and {O} form a venture|{C} investors vote on the merger|Regulator opens a probe into {C}|{C} settles with the regulator for {D}|{C} expands into Europe|{C} production rises to {N} units|{C} deliveries drop to {N} cars|{C} borrows {D} for a new line
{C} closes its factory in Spain|{C} hires a banker from {O}|{C} users grow to {N} million|Activist investor takes a {P} stake in {C}|Billionaire investor raises his bet on {C}|{C} board approves the sale of a unit|{C} strike ends after talks|{C} bookings rise, outlook raised|{C} to trade in Singapore from May
Senator sells shares of {C}|{C} names {O} executive as finance chief|{C} data breach hits {N} users|{C} drug trial succeeds|{C} loses appeal in tax case|{C} bond sale draws {D} of orders|{C} price cuts hit margins|{C} stock could jump {P}, says analyst|{C} would rise if rates fall, fund manager says
{C} buys back {N} shares from its founder|{C} market share falls to {P}|{C} stake sale to fund {D} plant|{C} trading platform goes down|{C} record quarter lifts dividend|{C} hits production goal of {N}|{C} tops sales record|Bank says {C} is expected to rise {P}|{C} subscribers fall {P}|{C} output drops {P} on strike
{C} income up {P}|{C} earnings climb {P}|{C} cash flow falls {P} on spending|{C} profit climbs as costs ease|{C} revenue dips {P}|{C} payout up {P}|Copper prices edge lower|Wheat prices climb {P}|{C} net loss widens {P}|{C} turnover rises {P} in Asia
{C} director sells {N} shares|{C} chairman buys {N} shares of the company|{C} buys stake in {O}|{C} cuts {N} posts|{C} hires {N} engineers|{C} sells stake in port to {O}|{C} finance chief acquires {N} shares|{C} sells its shares of {O}""",
}
JUDGED = {
    "recap": "{C} stock drops {P} on weak demand|{C} shares are up after the call|Shares of {C} slide as rivals cut prices|{C} trading down {P} at noon|{C} hits a new yearly high|Stocks making the biggest moves midday: {C}|{C} rises more than the market|{C} rallies {P} and {O} follows|{C} shares close {P} lower|Why shares of {C} are falling today|{C} plunges {P} in early trading|{C} stock slips {P} again",
    "fund": "{F} cuts stake in {C} ({T})|{C} ({T}) stock bought by {F}|{N} shares of {C} ({T}) purchased by {F}|{C} ({T}) shares acquired by {F}|Stake in {C} ({T}) trimmed by {F}|{F} sells {N} shares of {C} ({T}) stock|{F} has {D} stock holdings in {C} ({T})|{F} lifts its holdings in {C} ({T})|{F} buys a new stake in {C} ({T})|{C} ({T}) position reduced by {F}|{C} ({T}) price quote|{F} decreases its position in {C} ({T})",
    "news": "{C} revenue rises {P} in the quarter|{C} could surge {P} next year, says broker|{C} opens a store in Madrid|{C} names a new finance chief|Gold prices climb|{C} sells its stake in {O} stores|{C} chief executive sells {N} stock|{C} profit drops {P}, outlook cut|{C} wins order for {N} trains|{C} to acquire {O} for {D}|Regulator sues {C} over prices|{C} launches a cheaper plan|{C} sales beat estimates|{C} recalls {N} phones|{C} agrees to sell a unit to {O}|{C} plans a plant in Texas|{C} raises its dividend|Analyst cuts price target for {C}|{C} settles patent case with {O}|{C} deliveries climb to {N}",
}


def shapes(of: dict[str, str]) -> list[tuple[str, str]]:
    """(kind, shape) of every shape, in order."""
    return [(kind, shape) for kind, text in of.items() for shape in text.replace("\n", "|").split("|")]


def filled(shape: Column, company: Column, other: Column, number: Column) -> Column:
    """A headline: the shape with names and with figures that come from a number."""
    n = F.pmod(number, F.lit(900)) + 101
    slots = {
        "{C}": company,
        "{O}": other,
        "{F}": F.concat(other, F.element_at(F.array(*map(F.lit, (" Capital LLC", " Advisors Inc.", " Wealth Partners LP", " Trust Co"))), (F.pmod(number, F.lit(4)) + 1).cast("int"))),
        "{T}": F.concat(F.lit("$"), F.upper(F.substring(company, 1, 4))),
        "{N}": F.concat(F.floor(n / 10), F.lit(","), n),
        "{D}": F.concat(F.lit("$"), n, F.element_at(F.array(F.lit(" million"), F.lit(".5 million"), F.lit(" billion")), (F.pmod(number, F.lit(3)) + 1).cast("int"))),
        "{P}": F.concat((F.pmod(number, F.lit(290)) + 10) / 10, F.lit("%")),
    }
    for slot, value in slots.items():
        shape = F.replace(shape, F.lit(slot), value.cast("string"))
    return shape


def headlines(spark: SparkSession, sf_dir: str, of: dict[str, str]) -> DataFrame:
    """(o_orderkey, kind, title): an order's number picks a shape, its customer and clerk's numbers the names."""
    every = shapes(of)
    o = table(spark, sf_dir, "orders")
    at = (F.col("o_orderkey") % len(every) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in every]), at)
    name = lambda n: F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod(n, F.lit(len(NAMES))) + 1).cast("int"))
    return o.select("o_orderkey", pick(0).alias("kind"), filled(pick(1), name(F.col("o_custkey")), name(F.col("o_custkey") + F.col("o_orderkey") + 1), F.col("o_orderkey")).alias("title"))


#: Companies of our own.
NAMES = "Acme|Bolt Motors|Cobalt Foods|Dunmore|Eastway Air|Fenwick Labs|Garnet Steel|Harrow & Lane|Ironbridge|Juniper Rail|Kestrel Bank|Lumen Power".split("|")
