"""Template residue on wording that the grammar wasn't written from, boilerplate of a host, records that go on."""

from pyspark.sql import functions as F

from quillspark.llm.residue import template_residue

SCHEMA = "story_row_id long, platform string, story_content string, cloudflare_detected boolean, kind int"
FOUND = [
    "Enable JavaScript and cookies to continue", "Please turn JavaScript on and reload the page.", "JavaScript must be enabled in order for you to use this site.", "Your browser does not support JavaScript.",
    "You need to enable JavaScript to run this app.", "This site requires JavaScript to function properly.", "Javascript is required to view this page", "Scripts are disabled. Please enable scripts.", "To view the campaign, please enable JavaScript in your browser settings.",
    "Verify you are human by completing the action below", "Checking if the site connection is secure", "Checking your browser before accessing shop.example", "Please verify you are a human", "Please complete the captcha below",
    "Sorry, you have been blocked", "Error establishing a database connection", "This site can't be reached", "The page you requested could not be found.", "Our site is down for maintenance. Please check back soon.", "The server is temporarily unavailable, please try again later.",
    "404. That page does not exist.", "502 Bad Gateway\nnginx", "Error 1020\nAccess denied", "Your connection was interrupted", "The requested URL was not found on this server.", "Your session has expired. Please log in again.", "An error has occurred while processing your request.", "Too many requests. Slow down.",
    "This project is no longer available", "Failed to load resource: the server responded with a status", "We couldn't find the page you were looking for.", "HTTP/1.1 503 Service Unavailable",
    "Insert your story here.", "Dear [Name], thank you for backing our lamp.", "Welcome [FIRST NAME], you pledged [AMOUNT] to us.", "We call it [Project Title].", "Your text goes here", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Hi #{first_name}, thank you!", "Add your project description here.", "Click to edit this text",
]
KEPT = [
    "We build a lamp of oak in a small shop, and we test every one of them with care before it leaves.\n\nForbidden\n\nIs the name of the second chapter, in which the captain of the ship finds an island that no map shows.",
    "Chapters of the novel, each of which has been read by more than thirty people before it was printed:\n\nHome\nGone\nReturn", "The album has a song named Service Unavailable, recorded at home.", "Access denied was the working title of our heist game.",
    "Our script runs in the browser, and the board is programmed in JavaScript.", "We enable makers to build robots at home.", "Press and hold the button until the lamp turns blue.", "Please try our bread again later this year!", "[Edit: the second goal was reached in March!]", "[Video] The lamp at night", "Please check the sizes before you order.",
    "The page count went up to 200, and the paper is thicker now.", "Type the name of your dog, and we engrave it.", "Our site opens in May.", "We could not find a lamp like that, so we made one.", "The connection between the two halves is made of brass.", "Something went very right last year.", "Error bars are printed in red.",
    "Insert the battery here, then close the lid.", "It was blocked by a tree.", "This game needs two players.", "The server brings the soup.", "Enter your size in the survey.", "Our team has been working on this for 404 days.", "Gone are the days of cold tea.",
]
# a second list, written after the grammar and not used to mend it: nine in ten must come out right
LATER_FOUND = [
    "This webpage is not available", "You don't have permission to access this resource.", "Please activate JavaScript to see this campaign.", "JavaScript seems to be off. Please turn it on.", "Confirm you are not a robot to go on.", "Service temporarily unavailable",
    "The database server could not be reached.", "Whoops, something went wrong on our end.", "Error: connection refused", "ERR_CONNECTION_TIMED_OUT", "Your access has been temporarily blocked.", "The link you followed has expired.", "500 - Internal server error.", "Unfortunately, this page no longer exists.",
    "We are verifying your browser. This takes a few seconds.", "Meet [Company Name], the makers of it.", "Put your text here", "Dear {{ customer.name }}, hello.", "Placeholder text, do not publish", "Dolor sit amet, sed do eiusmod tempor incididunt ut labore.",
]
LATER_KEPT = [
    "The bridge was blocked, so we walked.", "Scripts of all ten scenes are in the book.", "Please allow three weeks for delivery.", "We need two more hands.", "The file cabinet is made of steel.", "The page you hold was printed in Turin.", "Check the size chart below.", "Our host opened the door.", "Nothing went wrong, and we shipped in May.",
    "Are you a human or a dancer? Play to find out.", "The address is engraved on the back.", "The first session was recorded in June.", "Write a letter here, read it there: that is the game.", "The request came from a friend.", "Limit: one box a backer.", "Try again and again: each game takes ten minutes.",
]


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["story_row_id"]: r["kind"] for r in template_residue(df).collect()}


def test_unseen_wording(spark):
    got = run(spark, [(i, "h", t, None, 1) for i, t in enumerate(FOUND + KEPT)])
    missed = [t for i, t in enumerate(FOUND) if got[i] is None]
    wrong = [t for i, t in enumerate(KEPT, len(FOUND)) if got[i] is not None]
    assert not missed and not wrong, (missed, wrong)
    got = run(spark, [(i, "h", t, None, 1) for i, t in enumerate(LATER_FOUND + LATER_KEPT)])
    hits = sum(got[i] is not None for i in range(len(LATER_FOUND)))
    false = sum(got[i] is not None for i in range(len(LATER_FOUND), len(got)))
    print("later list:", hits, "of", len(LATER_FOUND), [t for i, t in enumerate(LATER_FOUND) if got[i] is None], [t for i, t in enumerate(LATER_KEPT, len(LATER_FOUND)) if got[i] is not None])
    assert hits >= 0.9 * len(LATER_FOUND) and hits >= 0.9 * (hits + false)


def story(i):
    return f"Our lamp number {i} is made of oak and felt, and we test every part of it by hand at home.", f"In month {i} we ship the first of the {i + 7} boxes to all who waited for them so patiently this year."


def test_lines_shared_by_a_hosts_stories_are_subtracted(spark):
    line = "Please enable JavaScript to see the video."
    a = [(i, "h", "\n\n".join([story(i)[0], line, story(i)[1]]), None, 1) for i in range(60)]  # amid the story
    b = [(100 + i, "h", "\n\n".join([*story(100 + i), line]), None, 1) for i in range(60)]  # as a footer
    c = [(900, "h", line, None, 1), (901, "h", f"{line}\n\nSupported browsers", None, 1)]  # alone it replaces the story
    d = [(902, "other", "\n\n".join([story(5)[0], line]), None, 1), (903, None, "\n\n".join([story(6)[0], line]), None, 1)]  # recurs nowhere there
    got = run(spark, a + b + c + d)
    assert all(got[i] is None for i in [*range(60), *range(100, 160)])
    assert all(got[i] == "script_notice" for i in (900, 901, 902, 903))


def test_a_copied_text_counts_once(spark):
    line = "Access denied"
    copies = [(i, "h", f"{story(1)[0]}\n\n{line}", None, 1) for i in range(50)]
    others = [(100 + i, "h", "\n\n".join(story(i)), None, 1) for i in range(100)]
    got = run(spark, copies + others)
    assert all(got[i] == "error" for i in range(50)) and all(got[100 + i] is None for i in range(100))


def test_slots_are_never_subtracted(spark):
    rows = [(i, "h", f"{story(i)[0]}\n\nWrite to {{{{contact}}}} for help with it.\n\n{story(i)[1]}", None, 1) for i in range(40)]
    assert set(run(spark, rows).values()) == {"slot"}


def test_the_flag_tips_only_weak_evidence(spark):
    t = "\n\n".join([*story(1), "Forbidden"])
    got = run(spark, [(1, "h", t, True, 1), (2, "h", t, False, 1), (3, "h", t, None, 1), (4, "h", "\n\n".join(story(2)), True, 1), (5, "h", "Forbidden", None, 1)])
    assert got == {1: "error", 2: None, 3: None, 4: None, 5: "error"}


def test_repeated_rows_and_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "h", "Access denied", None, 1), (1, "h", "Access denied", None, 1), (1, "h", "A lamp.", None, 1)], SCHEMA).withColumn("is_residue", F.lit("x"))
    assert sorted(r["kind"] or "" for r in template_residue(df).collect()) == ["", "error", "error"]
    assert template_residue(df.drop("cloudflare_detected")).count() == 3
    assert template_residue(df.limit(0)).count() == 0
